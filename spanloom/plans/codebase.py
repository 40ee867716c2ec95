"""A code corpus of any size, made by rule from the rows of a table, and what it holds, as relations.

Each file is a header and some blocks. A block's text and its declarations and comments are stated here side by side, so
SQL can tell where everything stands by adding up line counts, without looking at code. The engine sees the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Block:
    """text: lines, `@` standing for a number; decls: (first line, last line, name, kind, depth); notes: the lines with comments, blanked but for these; codes: the lines with literals, these blanked."""

    text: tuple[str, ...]
    decls: tuple[tuple[int, int, str, str, int], ...] = ()
    notes: tuple[tuple[int, str], ...] = ()
    codes: tuple[tuple[int, str], ...] = ()


PYTHON = (
    Block(("def load_@(path):", "    # reads the token cache", "    data = open(path)", "    return parse_@(data)", "", ""), ((1, 4, "load_@", "def", 0),), ((2, "    # reads the token cache"),)),
    Block(
        ("class Store_@(Base):", '    """Keeps def fake(token): apart."""', "    size = 3", "", "    async def load_@(self, key):", '        url = "http://x/#token"', "        return self.map[key]  # token of a key", "", ""),
        ((1, 4, "Store_@", "class", 0), (5, 7, "load_@", "def", 1)),
        ((7, "                              # token of a key"),),
        ((2, ""), (6, "        url =")),
    ),
    Block(("handle_@ = lambda req: load_@(req.token)", "LIMIT = [", "    1, 2,", "]", ""), ((1, 1, "handle_@", "function", 0),)),
    Block(("def long_@():", *("    step()" if k != 16 else "    step(token)" for k in range(34)), ""), ((1, 35, "long_@", "def", 0),)),
    Block(("import token", "", "print('no', start_@, 'load_@')", *[""] * 9), codes=((3, "print(    , start_@,         )"),)),
)
RUST = (
    Block(
        ("/// loads a token", "pub(crate) fn load_@<T: Fn(u8) -> u8>(path: &str) -> Option<T> {", "    let s = 'a'; // token", "    parse_@(path)", "}", ""),
        ((2, 5, "load_@", "fn", 0),),
        ((1, "/// loads a token"), (3, "                 // token")),
        ((3, "    let s =    ;"),),
    ),
    Block(
        ("#[derive(Debug)]", "pub struct Store_@<T> {", "    map: Map<T>,", "}", "impl<T> Store_@<T> {", "    pub unsafe fn load_@(&self) -> T {", "        self.token", "    }", "}", ""),
        ((2, 4, "Store_@", "struct", 0), (5, 5, "Store_@", "impl", 0), (6, 8, "load_@", "fn", 1)),
    ),
)
SCRIPT = (
    Block(
        ("/* token", "   block */", "export class Store_@ {", "  load_@ = async (id) => {", "    return fetch(id) // token", "  }", "}", ""),
        ((3, 3, "Store_@", "class", 0), (4, 6, "load_@", "function", 1)),
        ((1, "/* token"), (2, "   block */"), (5, "                     // token")),
    ),
    Block(("export default function start_@(token) {", "  if (ready(token)) {", "    handle_@(token) || load_@(token);", "  }", "}"), ((1, 5, "start_@", "function", 0),)),
)
OTHER = (
    Block(("#include <token.h>", "static int load_@(const char *path) {", "  return parse_@(path); /* token */", "}", ""), ((2, 4, "load_@", "function", 0),), ((3, "                        /* token */"),)),
    Block(("type Store_@ struct {", "  Token string", "}", "func (r *Store_@) Load_@(token string) error {", "  return nil", "}", ""), ((1, 3, "Store_@", "type", 0), (4, 6, "Load_@", "func", 0))),
)
LANGUAGES = ((".py", PYTHON), (".rs", RUST), (".ts", SCRIPT), (".go", OTHER))
FOLDERS = ("src/app", "lib/load", "tests", "src/store")
#: Blocks in a file: 1 to MOST.
MOST = 5


NAMES = ("load", "store_", "load_store", "main")


def path_of(doc_id: int) -> str:
    return f"{FOLDERS[doc_id // 4 % len(FOLDERS)]}/{NAMES[doc_id // 16 % len(NAMES)]}_{doc_id}{LANGUAGES[doc_id % len(LANGUAGES)][0]}"


def files(rows: DataFrame, number: Column | None = None) -> DataFrame:
    """(path, content): a file for each row of (doc_id). number stands in its names, the last digit of doc_id by default."""
    d = F.col("doc_id")
    at = lambda options, i: F.element_at(F.array(*map(F.lit, options)), (i % len(options) + 1).cast("int"))
    number = (d % 10 if number is None else number).cast("string")
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (ending, blocks) in enumerate(LANGUAGES):
        mine = d % len(LANGUAGES) == k
        name = F.concat(at(FOLDERS, F.floor(d / 4)), F.lit("/"), at(NAMES, F.floor(d / 16)), F.lit("_"), d.cast("string"), F.lit(ending))
        texts = ["\n".join(b.text) + "\n" for b in blocks]
        parts = [F.when(d % MOST >= j, at(texts, d * 7 + j * 3)).otherwise("") for j in range(MOST)]
        path = F.coalesce(path, F.when(mine, name))
        content = F.coalesce(content, F.when(mine, F.concat(F.lit("\n"), *(F.regexp_replace(p, "@", number) for p in parts))))
    return rows.select("doc_id", path.alias("path"), content.alias("content"))


def _values(rows: list[tuple]) -> str:
    one = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _each() -> list[tuple[int, int, Block]]:
    return [(k, t, b) for k, (_, blocks) in enumerate(LANGUAGES) for t, b in enumerate(blocks)]


def relations(number: str = "doc_id % 10") -> str:
    """CTEs code_files (path, doc_id), code_lines (path, line_no, text), code_decls (path, start_line, end_line, name, kind, depth) and code_notes (path, line_no, text: comments alone) and code_bare (lines with literals, these blanked)."""
    counts = _values([(k, len(blocks), ending) for k, (ending, blocks) in enumerate(LANGUAGES)])
    folders = _values([(i, f) for i, f in enumerate(FOLDERS)])
    lines = _values([(k, t, n, x) for k, t, b in _each() for n, x in enumerate(b.text, 1)])
    decls = _values([(k, t, *d) for k, t, b in _each() for d in b.decls])
    notes = _values([(k, t, *x) for k, t, b in _each() for x in b.notes])
    codes = _values([(k, t, *x) for k, t, b in _each() for x in b.codes])
    return f"""cb_langs(k, blocks, ending) AS (VALUES {counts}), cb_folders(i, folder) AS (VALUES {folders}),
 cb_lines(k, t, n, text) AS (VALUES {lines}), cb_decls(k, t, a, z, name, kind, depth) AS (VALUES {decls}), cb_notes(k, t, n, text) AS (VALUES {notes}), cb_codes(k, t, n, text) AS (VALUES {codes}),
 cb_size AS (SELECT k, t, count(*) AS size FROM cb_lines GROUP BY ALL),
 cb_blocks AS (SELECT doc_id, l.k, j.j, (doc_id * 7 + j.j * 3) % l.blocks AS t, folder || '/' || {list(NAMES)}[((doc_id // 16) % 4 + 1)::INT] || '_' || doc_id || ending AS path, ({number})::VARCHAR AS num
   FROM documents JOIN cb_langs l ON l.k = doc_id % {len(LANGUAGES)} JOIN cb_folders ON i = (doc_id // 4) % {len(FOLDERS)}, (SELECT unnest(range({MOST})) AS j) j WHERE doc_id % {MOST} >= j.j),
 cb_placed AS (SELECT b.*, 1 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM cb_blocks b JOIN cb_size s ON s.k = b.k AND s.t = b.t),
 code_files AS (SELECT DISTINCT path, doc_id FROM cb_blocks),
 code_lines AS (SELECT path, base + n AS line_no, replace(text, '@', num) AS text FROM cb_placed p JOIN cb_lines l ON l.k = p.k AND l.t = p.t UNION ALL SELECT path, 1, '' FROM code_files),
 code_decls AS (SELECT path, base + a AS start_line, base + z AS end_line, replace(name, '@', num) AS name, kind, depth FROM cb_placed p JOIN cb_decls d ON d.k = p.k AND d.t = p.t),
 code_notes AS (SELECT path, base + n AS line_no, replace(text, '@', num) AS text FROM cb_placed p JOIN cb_notes x ON x.k = p.k AND x.t = p.t),
 code_bare AS (SELECT path, base + n AS line_no, replace(text, '@', num) AS text FROM cb_placed p JOIN cb_codes x ON x.k = p.k AND x.t = p.t)"""
