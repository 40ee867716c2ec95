"""Queries over code: a corpus made by rule, whose declarations and comments SQL knows by adding up line counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.declare import code_lines, comment_lines, with_declarations
from ..operators import fetch, match, render
from . import codebase, quality
from .options import Options
from .patterns import compile_patterns
from .registry import query
from .search import search

CODE = codebase.relations()
PIECES = T.TOKEN_PIECES.replace("'", "''")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebase.files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")).select("path", "content")


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@dataclass(frozen=True)
class Asked:
    """A search as SQL: plain patterns with the terms of each, and what of the options bears on it."""

    patterns: tuple[str, ...]
    terms: tuple[tuple[str, ...], ...]
    max_tokens: int | None = None
    context: int = 6
    comments: bool = False
    where: str = "true"
    tests: str = "true"
    word: bool = False
    code: str = CODE

    def spans(self) -> str:
        """CTEs up to sc: every span with its score, after the gate where there is a budget."""
        n, whole = len(self.patterns), 1 << 60 if self.max_tokens is None else max(1, self.max_tokens // 12)
        pats = ", ".join(f"({i}, '{p}')" for i, p in enumerate(self.patterns))
        terms = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in ts) + "]" for ts in self.terms) + "]"
        source = "code_notes" if self.comments else "code_lines"
        hit = (lambda x: f"regexp_matches({x}, '\\b' || p || '\\b')") if self.word else (lambda x: f"contains({x}, p)")
        counts = ", ".join(f"count(*) FILTER (q = {i}) AS q{i}" for i in range(n))
        sums = ", ".join(f"sum(q{i}) AS q{i}" for i in range(n))
        per = "[" + ", ".join(f"q{i}" for i in range(n)) + "]"
        out = f"""{self.code}, pats(q, p) AS (VALUES {pats}),
 m AS (SELECT l.path, l.line_no AS line, q, p FROM {source} l JOIN pats ON {hit('l.text')} WHERE {self.tests.replace("path", "l.path")}),
 total AS (SELECT path, max(line_no) AS total FROM code_lines GROUP BY 1),
 names AS (SELECT path, string_split(string_split(path, '/')[-1], '.')[1] AS stem FROM code_files),
 ps AS (SELECT path, q, {terms}[q + 1] AS ts, stem, list_filter(string_split(stem, '_'), lambda x: x <> '') AS parts FROM names, pats),
 path_scores AS (SELECT path, q, CASE WHEN list_contains(ts, stem) THEN 1.0 ELSE len(list_filter(parts, lambda x: list_contains(ts, x)))::DOUBLE / len(parts) END AS score FROM ps),
 any_line AS (SELECT DISTINCT path, line FROM m),
 firsts AS (SELECT path, line FROM any_line QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 16),
 hints AS (SELECT DISTINCT f.path FROM firsts f JOIN code_decls d ON d.path = f.path AND d.start_line = f.line JOIN pats ON {hit('d.name')} WHERE kind <> 'impl'),
 cand AS (SELECT a.path, a.path IN (SELECT path FROM hints) AS hint, least(count(*), 512) AS match_count, (SELECT max(score) FROM path_scores s WHERE s.path = a.path) AS best_path FROM any_line a GROUP BY a.path),
 ranked AS (SELECT *, row_number() OVER (ORDER BY hint DESC, match_count DESC, best_path DESC, path) AS candidate_rank FROM cand),
 near AS (SELECT m.*, d.start_line AS ds, d.end_line AS de, d.name, d.kind, d.depth FROM m ASOF LEFT JOIN code_decls d ON m.path = d.path AND m.line >= d.start_line),
 inside AS (SELECT path, line, q, p, total, CASE WHEN de >= line THEN ds END AS ds, CASE WHEN de >= line THEN de END AS de, name, kind, depth FROM near JOIN total USING (path)),
 w0 AS (SELECT *, ds IS NOT NULL AND (de - ds < {whole} OR line = ds) AS named,
   CASE WHEN ds IS NULL THEN greatest(1, line - {self.context}) WHEN de - ds < {whole} THEN ds ELSE greatest(line - {self.context}, ds) END AS s,
   CASE WHEN ds IS NULL THEN least(line + {self.context}, total) WHEN de - ds < {whole} THEN least(de, total) ELSE least(line + {self.context}, total, de) END AS e FROM inside),
 w AS (SELECT path, line, q, s, e, CASE WHEN named THEN name END AS symbol, CASE WHEN named THEN kind END AS kind, CASE WHEN named THEN depth ELSE 0 END AS depth,
   coalesce(s = line AND named AND kind <> 'impl' AND {hit('name')}, false) AS declares FROM w0),
 c AS (SELECT path, s, e, symbol IS NOT NULL AS has_symbol, min(symbol) AS symbol, min(kind) AS kind, max(depth) AS depth, list(line) AS lines, min(line) AS first, {counts}, min(q) FILTER (declares) AS declaring FROM w GROUP BY 1, 2, 3, 4),
 fr AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY path ORDER BY s, e, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM c),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY s, e, first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fr),
 r AS (SELECT path, min(s) AS start_line, max(e) AS end_line, min(struct_pack(a := s, b := e, f := first, symbol := symbol, kind := kind, depth := depth)) FILTER (has_symbol) AS lead, list_sort(list_distinct(flatten(list(lines)))) AS match_lines, {sums}, min(declaring) AS declaring FROM g GROUP BY path, island),
 o AS (SELECT path, start_line, end_line, lead.symbol AS symbol, lead.kind AS kind, coalesce(lead.depth, 0) AS depth, match_lines, declaring IS NOT NULL AS is_declaration,
   coalesce(declaring, list_position({per}, list_max({per})) - 1) AS query_index, list_filter(range({n}), lambda i: {per}[i + 1] > 0) AS answered FROM r),
 sp AS (SELECT o.path, start_line, end_line, any_value(symbol) AS symbol, any_value(kind) AS kind, any_value(depth) AS depth, any_value(match_lines) AS match_lines, any_value(is_declaration) AS is_declaration, any_value(query_index) AS query_index, any_value(answered) AS answered,
   string_agg(l.text, chr(10) ORDER BY l.line_no) AS text FROM o JOIN code_lines l ON l.path = o.path AND l.line_no BETWEEN start_line AND end_line GROUP BY o.path, start_line, end_line),
 ts AS (SELECT sp.*, len(regexp_extract_all(text, '{PIECES}'))::BIGINT AS tokens, ln(1 + len(match_lines)) AS s_matches, 1.5 * len(list_filter({terms}[query_index + 1], lambda t: contains(lower(text), t)))::DOUBLE / len({terms}[query_index + 1]) AS s_terms,
   x.score AS s_path, candidate_rank FROM sp JOIN path_scores x ON x.path = sp.path AND x.q = query_index JOIN ranked k ON k.path = sp.path),"""
        if self.max_tokens is None:
            out += " gated AS (SELECT * FROM ts),"
        else:
            share = max(1, 4 * self.max_tokens // n)
            out += f"""
 bt AS (SELECT *, (candidate_rank - 1) // 8 AS batch FROM ts),
 sums AS (SELECT batch, query_index, sum(tokens) AS t FROM bt GROUP BY ALL),
 grid AS (SELECT b.batch, pats.q, sum(coalesce(t, 0)) OVER (PARTITION BY pats.q ORDER BY b.batch) AS total FROM (SELECT DISTINCT batch FROM bt) b CROSS JOIN pats LEFT JOIN sums ON sums.batch = b.batch AND sums.query_index = pats.q),
 halt AS (SELECT min(batch) AS stop FROM (SELECT batch FROM grid GROUP BY batch HAVING min(total) >= {share})),
 gated AS (SELECT bt.* FROM bt, halt WHERE stop IS NULL OR batch <= stop),"""
        order = "is_declaration DESC, round(score, 9) DESC, path, start_line"
        last = order if n == 1 else "lane, query_index"
        return out + f"""
 least_depth AS (SELECT symbol, min(depth) AS least FROM gated WHERE is_declaration AND symbol IS NOT NULL GROUP BY 1),
 pen AS (SELECT gated.*, CASE WHEN is_declaration AND least IS NOT NULL THEN (gated.depth - least)::DOUBLE ELSE 0.0 END AS s_depth FROM gated LEFT JOIN least_depth USING (symbol)),
 sel AS (SELECT *, s_matches + s_terms + s_path - s_depth AS score, [{", ".join(f"'{p}'" for p in self.patterns)}][query_index + 1] AS query FROM pen WHERE {self.where}),
 laned AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY {order}) AS lane FROM sel),
 sc AS (SELECT *, row_number() OVER (ORDER BY {last}) AS place FROM laned)"""


def filled(source: str, most: int, cap: int, floor: int = 0) -> str:
    """CTE taken (place): the greedy fill of source (place, path, tokens, is_declaration), the last declarations giving way until floor others fit.

    A step takes the next row that fits, or ends an attempt; the next attempt bars one declaration more. The last row of the first attempt that has enough references, or else of the plain one, holds what is taken.
    """
    room = f"len(list_filter(t.paths, lambda x: x = d.path)) < {cap} AND" if cap else ""
    return f"""steps AS (
  SELECT 0::BIGINT AS attempt, 0::BIGINT AS place, 0::BIGINT AS used, []::BIGINT[] AS got, []::VARCHAR[] AS paths, []::BIGINT[] AS decls, []::BIGINT[] AS barred, false AS ended
  UNION ALL
  SELECT CASE WHEN again THEN attempt + 1 ELSE attempt END, CASE WHEN again THEN 0 ELSE coalesce(nxt.place, place) END, CASE WHEN again THEN 0 ELSE used + coalesce(nxt.tokens, 0) END,
         CASE WHEN again THEN [] WHEN nxt IS NULL THEN got ELSE list_append(got, nxt.place) END, CASE WHEN again THEN [] WHEN nxt IS NULL THEN paths ELSE list_append(paths, nxt.path) END,
         CASE WHEN again THEN [] WHEN nxt IS NOT NULL AND nxt.is_declaration THEN list_append(decls, nxt.place) ELSE decls END, CASE WHEN again THEN list_append(barred, decls[-1]) ELSE barred END, NOT again AND nxt IS NULL
  FROM (SELECT *, ended AND len(got) - len(decls) < {floor} AND len(decls) > 0 AS again FROM (
    SELECT t.*, CASE WHEN t.ended OR t.used >= {most} THEN NULL ELSE (SELECT min(struct_pack(place := d.place, path := d.path, tokens := d.tokens, is_declaration := d.is_declaration)) FROM {source} d
      WHERE d.place > t.place AND {room} t.used + d.tokens <= {most} AND NOT list_contains(t.barred, d.place)) END AS nxt FROM steps t))
  WHERE again OR NOT ended),
 final AS (SELECT got FROM steps WHERE ended AND (len(got) - len(decls) >= {floor} OR attempt = 0) ORDER BY attempt DESC LIMIT 1),
 taken AS (SELECT unnest(got) AS place FROM final)"""


TWO = Asked(("load_3", "token"), (("load", "3", "load_3"), ("token",)))
SHOWN = "path, start_line, end_line, symbol, kind, depth::INT AS depth, array_to_string(match_lines, ',') AS match_lines, is_declaration, query, tokens, round(score, 6) AS score, text"


def shown(found) -> DataFrame:
    return found.spans.select("path", "start_line", "end_line", "symbol", "kind", "depth", joined("match_lines").alias("match_lines"), "is_declaration", "query", "tokens", F.round("score", 6).alias("score"), "text")


@query(f"WITH {CODE} SELECT path, name, kind, start_line, end_line, depth::INT AS depth FROM code_decls")
def code_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four languages' declarations: kinds, names, bodies cut at the next declaration, depths."""
    return with_declarations(code(spark, sf_dir)).select("path", F.explode("decls").alias("d")).select("path", "d.*")


@query(f"""WITH {CODE} SELECT l.path, l.line_no, rtrim(CASE WHEN b.text IS NOT NULL THEN b.text WHEN n.text IS NULL THEN l.text
        ELSE array_to_string(list_transform(range(1, len(l.text) + 1), lambda i: CASE WHEN i > len(n.text) - len(ltrim(n.text)) AND i <= len(n.text) THEN ' ' ELSE l.text[i] END), '') END) AS code, coalesce(n.text, '') AS comments, strlen(l.text) AS width
        FROM code_lines l LEFT JOIN code_notes n ON n.path = l.path AND n.line_no = l.line_no LEFT JOIN code_bare b ON b.path = l.path AND b.line_no = l.line_no""")
def mask_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code without comments and literals, and comments alone; either as wide as the line."""
    both = code(spark, sf_dir).select("path", F.posexplode(F.arrays_zip(code_lines("content").alias("code"), comment_lines("content").alias("notes"))).alias("at", "x"))
    same = F.when(F.octet_length("x.code") == F.octet_length("x.notes"), F.octet_length("x.code").cast("long"))
    return both.select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.rtrim("x.code").alias("code"), F.rtrim("x.notes").alias("comments"), same.alias("width"))


@query(f"WITH {TWO.spans()} SELECT path, hint AS declaration_hint, match_count::INT AS match_count, round(best_path, 9) AS best_path, candidate_rank::INT AS candidate_rank FROM ranked")
def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of candidates, where hints, counts and path scores differ."""
    from ..operators import rank

    queries = compile_patterns(spark, list(TWO.patterns), Options())
    files = match.candidates(match.scout(match.with_lines(code(spark, sf_dir), Options()), queries), queries)
    placed = rank.placed(files.select("path", "declaration_hint", "match_count", "best_path"), [], match.candidate_order(), "candidate_rank")
    return placed.select("path", "declaration_hint", "match_count", F.round("best_path", 9).alias("best_path"), F.col("candidate_rank").cast("int").alias("candidate_rank"))


@query(f"WITH {TWO.spans()} SELECT {SHOWN} FROM sc")
def code_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of two patterns, with declarations, their windows, merges, scores and penalties."""
    return shown(search(code(spark, sf_dir), list(TWO.patterns), Options(max_tokens=None)))


def asked(name: str, doc: str, ask: Asked, options: Options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(search(code(spark, sf_dir), list(ask.patterns), options))

    run.__name__, run.__doc__ = name, doc
    pack = "" if options.max_tokens is None else ", " + filled("sc", options.max_tokens, options.cap, options.min_references)
    chosen = "sc" if options.max_tokens is None else "sc JOIN taken USING (place)"
    if options.max_tokens is None and options.cap:
        chosen = f"(SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY path ORDER BY place) <= {options.cap})"
    query(f"WITH RECURSIVE {ask.spans()}{pack} SELECT {SHOWN} FROM {chosen}")(run)


def but(**changes) -> Asked:
    from dataclasses import replace

    return replace(TWO, **changes)


asked("code_declarations_only", "Spans that declare what is asked for.", but(where="is_declaration"), Options(max_tokens=None, select="declarations"))
asked("code_references_only", "Spans that don't.", but(where="NOT is_declaration"), Options(max_tokens=None, select="references"))
asked("code_kinds", "Declarations of some kinds.", but(where="is_declaration AND kind IN ('fn', 'def', 'struct')"), Options(max_tokens=None, kinds=("fn", "def", "struct")))
asked("code_without_tests", "Files that don't look like tests.", but(tests="path NOT LIKE 'tests/%'"), Options(max_tokens=None, tests="exclude"))
asked("code_tests_only", "Files that do.", but(tests="path LIKE 'tests/%'"), Options(max_tokens=None, tests="only"))
asked("code_orphan_context", "Windows of one line around matches outside declarations.", but(context=1), Options(max_tokens=None, orphan_context=1))
asked("code_comments_only", "Matches in comments, whose spans are those of the code around them.", but(comments=True), Options(max_tokens=None, comments_only=True))
asked("code_per_file_cap", "Two spans of a file at most, without a budget.", TWO, Options(max_tokens=None, max_per_file=2))
asked("code_budget", "A budget: gate, lanes, cap and greedy fill; declarations of over 50 lines are cut.", but(max_tokens=600), Options(max_tokens=600))
asked("code_budget_small", "A budget under which whole declarations are cut to windows.", but(max_tokens=120), Options(max_tokens=120, max_per_file=0))
asked("code_one_pattern", "One pattern under a budget: no lanes.", Asked(("load_3",), (("load", "3", "load_3"),), max_tokens=900), Options(max_tokens=900, max_per_file=1))
asked("code_min_references", "Declarations give way until six other spans fit.", Asked(("load_3",), (("load", "3", "load_3"),), max_tokens=500), Options(max_tokens=500, min_references=6, max_per_file=0))


@query(f"WITH {CODE}, b AS (SELECT *, trim(text, ' ' || chr(9)) AS bare FROM code_lines) SELECT path, line_no, (strlen(text) - strlen(ltrim(text, ' ' || chr(9))))::INT AS indent, bare = 'end' OR bare <> '' AND translate(bare, ')]}};,', '') = '' AS closes FROM b")
def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indents, and the lines that only close a body."""
    lines = match.line_table(match.with_lines(code(spark, sf_dir), Options()))
    return lines.select("path", "line_no", X.indent(F.col("text")).alias("indent"), X.closes_body(F.col("text")).alias("closes"))


REASONS = "printf('  why matches %.2f + terms %.2f + path %.2f - depth %.2f = %.2f', s_matches, s_terms, s_path, s_depth, score) || CASE WHEN is_declaration THEN ', declaration' ELSE '' END"
HEADER = "path || ':' || start_line || '-' || end_line || CASE WHEN symbol IS NOT NULL AND kind IS NOT NULL THEN ' (' || kind || ' ' || symbol || ')' ELSE '' END || ' [' || tokens || ' tok]'"
BODY = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: lpad((start_line + i - 1)::VARCHAR, 6, ' ') || CASE WHEN list_contains(match_lines, start_line + i - 1) THEN ':' ELSE '-' END || x), chr(10))"


@query(f"WITH {TWO.spans()} SELECT path, start_line, {HEADER} || ' for ' || query || chr(10) || {REASONS} || chr(10) || {BODY} AS block, {HEADER} AS bare, {HEADER} || chr(10) || text AS plain FROM sc")
def rendered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: with numbers, reasons and patterns; anchors alone; plain."""
    spans = search(code(spark, sf_dir), list(TWO.patterns), Options(max_tokens=None, explain=True)).spans
    full = render.rendered(spans, line_numbers=True, why=True, queries=True)
    bare = render.rendered(full.withColumnRenamed("block", "full"), text=False).withColumnRenamed("block", "bare")
    return render.rendered(bare).select("path", "start_line", F.col("full").alias("block"), "bare", F.col("block").alias("plain"))


BUDGETED = Asked(TWO.patterns, TWO.terms, max_tokens=600)


@query(f"WITH RECURSIVE {BUDGETED.spans()}, {filled('sc', 600, 3)} SELECT (SELECT count(*) FROM cand) AS files_matched, (SELECT count(DISTINCT path) FROM gated) AS files_read, count(*) AS spans, sum(tokens)::BIGINT AS tokens, count(*) || ' spans, ' || sum(tokens) || '/600 tokens' AS said FROM sc JOIN taken USING (place)")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run counts: files matched and read, spans and tokens shown."""
    found = search(code(spark, sf_dir), list(TWO.patterns), Options(max_tokens=600))
    matched, read = found.counts()
    n, tokens = found.spans.agg(F.count("*"), F.sum("tokens")).first()
    return spark.createDataFrame([(matched, read, n, tokens, render.stats(found.spans, 600))], "files_matched long, files_read long, spans long, tokens long, said string")


#: Searches and what they end with: 0 for spans, 1 for none.
RUNS = (("load_3", "all"), ("load_33", "all"), ("Store_7", "all"), ("token", "declarations"), ("cache", "declarations"), ("fake", "all"))


@query(f"WITH {CODE}, r(pattern, selected) AS (VALUES {', '.join(map(str, RUNS))}) SELECT pattern, selected, CASE WHEN EXISTS (SELECT 1 FROM code_lines WHERE contains(text, pattern)) AND (selected = 'all' OR EXISTS (SELECT 1 FROM code_decls WHERE contains(name, pattern) AND kind <> 'impl')) THEN 0 ELSE 1 END AS status FROM r")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code(spark, sf_dir)
    rows = [(p, s, search(files, [p], Options(select=s)).exit_status) for p, s in RUNS]
    return spark.createDataFrame(rows, "pattern string, selected string, status int")


#: Anchors to read: lines 2 to 9 of the first files, one of them twice, one beyond its file's end.
FIRST = 60


def anchors() -> list[str]:
    return [f"{codebase.path_of(d)}:2-9" for d in range(1, FIRST)] + [f"{codebase.path_of(3)}: 1 - 2 ", f"./{codebase.path_of(5)}:3-99999"]


WANTED = f"""{CODE}, ask AS (SELECT path, 2 AS a, 9 AS z, doc_id AS place FROM code_files WHERE doc_id BETWEEN 1 AND {FIRST - 1} UNION ALL SELECT path, 1, 2, {FIRST} FROM code_files WHERE doc_id = 3 UNION ALL SELECT path, 3, 99999, {FIRST + 1} FROM code_files WHERE doc_id = 5),
 src AS (SELECT place, ask.path, a AS start_line, max(line_no) AS end_line, string_agg(text, chr(10) ORDER BY line_no) AS text FROM ask JOIN code_lines l ON l.path = ask.path AND line_no BETWEEN a AND z GROUP BY ALL),
 priced AS (SELECT *, len(regexp_extract_all(text, '{PIECES}'))::BIGINT AS tokens, false AS is_declaration FROM src)"""


@query(f"WITH {WANTED} SELECT path, start_line::BIGINT AS start_line, end_line, text, tokens, path || ':' || start_line || '-' || end_line AS anchor FROM priced")
def fetch_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors read back, repeats kept, ends cut at the file's."""
    return fetch.fetch(code(spark, sf_dir), anchors(), None).select("path", "start_line", "end_line", "text", "tokens", F.col("query").alias("anchor"))


@query(f"WITH RECURSIVE {WANTED}, {filled('priced', 400, 0)} SELECT path, start_line::BIGINT AS start_line, end_line, tokens FROM priced JOIN taken USING (place)")
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget leaves of them, in the order given."""
    return fetch.fetch(code(spark, sf_dir), anchors(), 400).select("path", "start_line", "end_line", "tokens")


#: Texts given as anchors, from the names of a table.
GIVEN = """given AS (SELECT n_nationkey AS k, ['a/b:c/' || n_name || '.py:' || n_nationkey || '-' || (n_nationkey + 3), n_name || ':9-3', '/abs/' || n_name || ':1-2', 'x/../../' || n_name || ':1-2', n_name || '.go : 4', 'up/../' || n_name || ':' || (n_nationkey + 1) || ' - 99 '] AS each FROM nation),
 texts AS (SELECT k, unnest(each) AS text FROM given)"""


@query(rf"""WITH {GIVEN}, p AS (SELECT *, regexp_extract(trim(text), '^(.+):\s*([0-9]+)\s*-\s*([0-9]+)$', ['path', 'a', 'z']) AS m FROM texts),
        q AS (SELECT text, regexp_replace(m.path, '^up/[.][.]/', '') AS path, try_cast(m.a AS BIGINT) AS a, try_cast(m.z AS BIGINT) AS z FROM p)
        SELECT text, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN a END AS start_line, CASE WHEN ok THEN z END AS end_line FROM (SELECT *, coalesce(a >= 1 AND z >= a, false) AND path NOT LIKE '/%' AND path NOT LIKE 'x/%' AS ok FROM q)""")
def anchor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors told from other texts: split from the right, within the root, from line 1 on, ends after starts."""
    out = []
    for k, name in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # the table of nations
        for text in (f"a/b:c/{name}.py:{k}-{k + 3}", f"{name}:9-3", f"/abs/{name}:1-2", f"x/../../{name}:1-2", f"{name}.go : 4", f"up/../{name}:{k + 1} - 99 "):
            try:
                path, start, end = fetch.parse_anchor(text)
                out.append((text, fetch.contained(path), start, end))
            except ValueError:
                out.append((text, None, None, None))
    return spark.createDataFrame(out, "text string, path string, start_line long, end_line long")


#: A tree from the tables of regions and nations: hidden, ignored, binary, broken and large files among the others.
TREE = """tree AS (SELECT *, CASE WHEN n_nationkey % 6 = 0 THEN '.hidden/' WHEN n_nationkey % 6 = 1 THEN 'build/' ELSE lower(r_name) || '/' END || n_name || CASE WHEN n_nationkey % 4 = 3 THEN '.log' ELSE '.txt' END AS path,
   CASE WHEN n_nationkey = 8 THEN 'large' WHEN n_nationkey = 9 THEN 'broken' WHEN n_nationkey % 5 = 2 THEN 'nul' ELSE 'plain' END AS kind FROM nation JOIN region ON r_regionkey = n_regionkey),
 listed AS (SELECT * FROM tree WHERE n_nationkey % 6 <> 0 AND n_nationkey % 6 <> 1 AND (path NOT LIKE '%.log' OR n_name = 'NATION_15'))"""


def tree(spark: SparkSession, sf_dir: str) -> str:
    """The tree's root: a local folder, as a command line meets it."""
    import os
    import tempfile

    root = tempfile.mkdtemp(prefix="spanloom-tree-")
    regions = dict(map(tuple, spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()))
    for k, name, region in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect():  # the table of nations
        folder = ".hidden" if k % 6 == 0 else "build" if k % 6 == 1 else regions[region].lower()
        text = f"line of {name}\nkey {k}\n".encode()
        data = b"x" * ((8 << 20) + 1) if k == 8 else b"\xff" + text if k == 9 else b"key 0 first\n\0" + text if k % 5 == 2 else text
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, folder, name + (".log" if k % 4 == 3 else ".txt")), "wb") as file:
            file.write(data)
    with open(os.path.join(root, ".gitignore"), "w") as file:
        file.write("# made\nbuild/\n*.log\n!NATION_15.log\n")
    return root


@query(f"WITH {TREE} SELECT path, CASE kind WHEN 'nul' THEN 13 ELSE 0 END + strlen('line of ' || n_name || 'key ' || n_nationkey) + 2 AS size FROM listed WHERE kind NOT IN ('large', 'broken')")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk: hidden and ignored files left out, large ones before they are read, and those that aren't UTF-8."""
    from ..sources import corpus

    return corpus.from_tree(spark, tree(spark, sf_dir)).select("path", "size")


@query(f"""WITH {TREE}, a AS (SELECT 'all' AS walk, path FROM tree WHERE kind NOT IN ('large', 'broken') UNION ALL SELECT 'hidden', path FROM tree WHERE kind NOT IN ('large', 'broken') AND n_nationkey % 6 <> 1 AND (path NOT LIKE '%.log' OR n_name = 'NATION_15')
        UNION ALL SELECT 'no ignore', path FROM tree WHERE kind NOT IN ('large', 'broken') AND n_nationkey % 6 <> 0 UNION ALL SELECT 'listed', path FROM tree WHERE n_nationkey < 8) SELECT * FROM a""")
def tree_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden files, ignored files, both, and a list of paths, which overrides either rule; an empty list reads nothing."""
    from ..sources import corpus

    root = tree(spark, sf_dir)
    every = corpus.from_tree(spark, root, hidden=True, no_ignore=True).filter(~F.col("path").endswith(".gitignore"))
    of = {"all": every, "hidden": corpus.from_tree(spark, root, hidden=True).filter(~F.col("path").endswith(".gitignore")), "no ignore": corpus.from_tree(spark, root, no_ignore=True)}
    first = [r[0] for r in every.select("path").collect() if int(r[0].split("NATION_")[1].split(".")[0]) < 8]
    of |= {"listed": corpus.from_tree(spark, root, paths=first + ["no/such.txt", *first]), "none": corpus.from_tree(spark, root, paths=[])}
    out = None
    for walk, files in of.items():
        one = files.select(F.lit(walk).alias("walk"), "path")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {TREE} SELECT (SELECT count(*) FROM listed WHERE kind = 'large') AS oversized, (SELECT count(*) FROM listed) - (SELECT count(*) FROM listed WHERE kind = 'large') AS kept")
def tree_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files were too large to read."""
    from ..sources import corpus

    kept, large = corpus.list_tree(tree(spark, sf_dir))
    return spark.createDataFrame([(large, len(kept))], "oversized long, kept long")


@query(f"WITH {TREE} SELECT path, CASE kind WHEN 'nul' THEN '1' ELSE '2' END AS found FROM listed WHERE kind = 'plain' OR kind = 'nul'")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a NUL counts by its lines before that."""
    from ..sources import corpus

    queries = compile_patterns(spark, ["key"], Options())
    files = match.scout(match.with_lines(corpus.from_tree(spark, tree(spark, sf_dir)), Options()), queries)
    return files.select("path", joined("found").alias("found"))


@query(f"WITH {TREE} SELECT path FROM tree WHERE n_nationkey % 6 <> 1 AND (path NOT LIKE '%.log' OR n_name = 'NATION_15') AND (n_nationkey % 3 = 0 OR n_nationkey % 7 = 5 OR kind = 'large')")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from where a branch began, committed since or not, and what git doesn't know yet but doesn't ignore."""
    import os
    import subprocess

    from ..sources import corpus

    root = tree(spark, sf_dir)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", "-c", "init.defaultBranch=main", *a], check=True, capture_output=True)
    number = lambda p: int(p.split("NATION_")[1].split(".")[0])
    paths = [p for p in corpus.list_tree(root, hidden=True)[0] if "NATION_" in p]
    later = [p for p in paths if number(p) % 7 == 5 and number(p) % 3]
    for p in later:
        os.rename(os.path.join(root, p), os.path.join(root, p + ".held"))
    git("init", "-q")
    git("add", "--", *[p for p in paths if p not in later], ".gitignore")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "work")
    for p in (p for p in paths if number(p) % 3 == 0):
        with open(os.path.join(root, p), "a") as file:
            file.write("more\n")
        if number(p) % 2:
            git("commit", "-qm", "more", "--", p)
    for p in later:
        os.rename(os.path.join(root, p + ".held"), os.path.join(root, p))
    return spark.createDataFrame([(p,) for p in corpus.changed_since(root, "main")], "path string")


#: Lists of paths and of anchors as text, from the names of a table.
@query("""WITH x AS (SELECT n_nationkey AS k, n_name AS n FROM nation) SELECT 'lines' AS form, n || '.txt' AS item FROM x WHERE k % 3 < 2 UNION ALL SELECT 'null', n || chr(10) || '.txt' FROM x UNION ALL SELECT 'anchors', n || ':1-' || (k + 1) FROM x WHERE k % 2 = 0""")
def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths one a line or parted by NUL, and anchors from the first words of lines."""
    from ..sources import corpus

    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # the table of nations
    lines = "".join(f"{n}.txt\r\n" if k % 3 == 0 else f"{n}.txt\n\n" if k % 3 == 1 else "" for k, n in rows)
    nul = "\0".join(f"{n}\n.txt" for _, n in rows) + "\0"
    told = "".join(f"  {n}:1-{k + 1} (def x) [3 tok]\n" if k % 2 == 0 else " \t\n" for k, n in rows)
    out = [("lines", x) for x in corpus.split_list(lines)] + [("null", x) for x in corpus.split_list(nul, True)] + [("anchors", x) for x in fetch.anchors_from(told)]
    return spark.createDataFrame(out, "form string, item string")


# The quality bench, over a corpus where three files share their names.
ASKED, SEED, ROOM = 12, 7, 300
SHARED = codebase.relations("doc_id // 3")
TOLD = f"""{SHARED}, words AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS symbol FROM code_lines),
 told AS (SELECT w.*, d.path IS NOT NULL AS is_definition FROM words w LEFT JOIN (SELECT DISTINCT path, start_line, name FROM code_decls WHERE kind <> 'impl') d ON d.path = w.path AND d.start_line = w.line_no AND d.name = w.symbol),
 idx AS (SELECT symbol, list_sort(list(DISTINCT path) FILTER (is_definition)) AS defs, list_sort(list(DISTINCT path) FILTER (NOT is_definition)) AS refs FROM told GROUP BY 1),
 worth AS (SELECT symbol, defs[1] AS path, list_sort(list_distinct(list_append(refs, defs[1]))) AS neighborhood FROM idx WHERE len(defs) = 1 AND NOT starts_with(symbol, '__') AND len(list_filter(refs, lambda p: p <> defs[1])) > 0),
 asked AS (SELECT * FROM worth ORDER BY md5(symbol || ':{SEED}'), symbol LIMIT {ASKED})"""
BASE = f"""{TOLD}, hits AS (SELECT t.* FROM told t JOIN asked a ON a.symbol = t.symbol),
 per AS (SELECT symbol, path, count(*) AS n, bool_or(is_definition) AS declares FROM hits GROUP BY ALL),
 near AS (SELECT DISTINCT h.symbol, h.path, l.line_no, l.text FROM hits h JOIN code_lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2),
 cost AS (SELECT symbol, path, len(regexp_extract_all(string_agg(text, chr(10) ORDER BY line_no), '{PIECES}'))::BIGINT AS cost FROM near GROUP BY ALL),
 ranked AS (SELECT per.symbol AS query, row_number() OVER (PARTITION BY per.symbol ORDER BY declares DESC, n DESC, per.path)::INT AS rank, per.path, cost FROM per JOIN cost ON cost.symbol = per.symbol AND cost.path = per.path),
 firsts AS (SELECT r.query, 1.0 / min(rank) AS mrr FROM ranked r JOIN asked a ON a.symbol = r.query AND a.path = r.path GROUP BY 1),
 fit AS (SELECT query, max(rank) AS last FROM ranked GROUP BY 1),
 walk AS (SELECT query, 0 AS rank, 0::BIGINT AS used, []::VARCHAR[] AS kept FROM fit UNION ALL
   SELECT r.query, r.rank, CASE WHEN w.used + r.cost <= {ROOM} THEN w.used + r.cost ELSE w.used END, CASE WHEN w.used + r.cost <= {ROOM} THEN list_append(w.kept, r.path) ELSE w.kept END FROM walk w JOIN ranked r ON r.query = w.query AND r.rank = w.rank + 1),
 kept AS (SELECT w.query, kept FROM walk w JOIN fit ON fit.query = w.query AND fit.last = w.rank),
 scores AS (SELECT a.symbol AS query, coalesce(f.mrr, 0.0)::DOUBLE AS mrr, list_contains(k.kept, a.path)::INT AS defined, len(list_intersect(k.kept, a.neighborhood))::DOUBLE / len(a.neighborhood) AS coverage
   FROM asked a JOIN kept k ON k.query = a.symbol LEFT JOIN firsts f ON f.query = a.symbol)"""


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebase.files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), F.floor(F.col("doc_id") / 3)).select("path", "content")


@query(f"WITH {TOLD} SELECT * FROM told")
def bench_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines, and which of them each language's own regexes call declarations."""
    return quality.mentions(shared(spark, sf_dir))


@query(f"WITH {TOLD} SELECT symbol, path, array_to_string(neighborhood, ',') AS neighborhood FROM asked")
def bench_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of symbols to ask for."""
    return quality.symbols(quality.mentions(shared(spark, sf_dir)), ASKED, SEED).select("symbol", "path", F.array_join("neighborhood", ",").alias("neighborhood"))


def bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = shared(spark, sf_dir)
    told = quality.mentions(files)
    asked = spark.createDataFrame(quality.symbols(told, ASKED, SEED).collect(), "symbol string, path string, neighborhood array<string>")  # ASKED rows
    return files, told, asked


@query(f"WITH RECURSIVE {BASE} SELECT query, rank, path, cost FROM ranked")
def bench_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's files in their order, with what their regions cost."""
    return quality.baseline(*bench(spark, sf_dir))


@query(f"WITH RECURSIVE {BASE} SELECT query, mrr, defined, coverage FROM scores")
def bench_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, told, asked = bench(spark, sf_dir)
    return quality.measure(quality.baseline(files, told, asked), asked, ROOM)


@query(f"WITH RECURSIVE {BASE} SELECT count(*) AS asked, avg(mrr) AS mrr, avg(defined) AS defined, avg(coverage) AS coverage FROM scores")
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, told, asked = bench(spark, sf_dir)
    return quality.report(quality.measure(quality.baseline(files, told, asked), asked, ROOM))


#: Names for the search itself, and its budget.
NAMES = ("load_9", "Store_20")


def system_sql() -> str:
    parts = []
    for name in NAMES:
        ask = Asked((name,), ((*name.lower().split("_"), name.lower()),), max_tokens=ROOM, word=True, code=SHARED)
        parts.append(f"SELECT * FROM (WITH RECURSIVE {ask.spans()}, {filled('sc', ROOM, 3)} SELECT '{name}' AS query, row_number() OVER (ORDER BY place)::INT AS rank, path, tokens AS cost FROM sc JOIN taken USING (place))")
    return " UNION ALL ".join(parts)


@query(system_sql())
def bench_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search returns for a name, in its order, with what it costs."""
    return quality.system(shared(spark, sf_dir), list(NAMES), ROOM)[0]
