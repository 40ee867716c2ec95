"""Queries of every operator over the driver's tables, and SQL that computes the same another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.declare import declared_names, with_declarations
from ..operators import fetch, match, pack, rank, regions, render
from ..sources.corpus import from_table, keep_paths
from . import metrics
from .code_queries import filled
from .options import Options
from .patterns import compile_patterns
from .registry import QUERIES, SQL, query  # noqa: F401
from .search import extract, search

ALL = Options(max_tokens=None)
FREE = Options(max_tokens=None, ignore_case=True)
THREE = ["license", "token", "MIT"]

DOCS = "docs AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content FROM documents WHERE text <> '')"
LINES = DOCS + r""", ls AS (SELECT path, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS lines FROM (SELECT path, string_split_regex(content, '\r?\n') AS s FROM docs)),
 l AS (SELECT path, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_no, len(lines) AS total FROM ls)"""
#: Matches of three patterns, their windows, and these merged to islands.
MATCHES = LINES + ", m AS (SELECT path, line_no AS line, q, total FROM l, (VALUES (0, 'license'), (1, 'token'), (2, 'MIT')) v(q, p) WHERE contains(text, p))"
WINDOWS = MATCHES + ", w AS (SELECT path, line, q, greatest(1, line - 6) AS s, least(line + 6, total) AS e FROM m)"
ISLANDS = (
    WINDOWS
    + """, c AS (SELECT path, s, e, list(line) AS lines, min(line) AS first, count(*) FILTER (q = 0) AS q0, count(*) FILTER (q = 1) AS q1, count(*) FILTER (q = 2) AS q2 FROM w GROUP BY path, s, e),
 f AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM c),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY s, e) AS island FROM f),
 r AS (SELECT path, min(s) AS start_line, max(e) AS end_line, list_sort(list_distinct(flatten(list(lines)))) AS match_lines, sum(q0) AS q0, sum(q1) AS q1, sum(q2) AS q2 FROM g GROUP BY path, island),
 o AS (SELECT *, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS query_index FROM r),
 sp AS (SELECT o.*, array_to_string(ls.lines[start_line:end_line], chr(10)) AS text FROM o JOIN ls USING (path)),
 sc AS (SELECT *, ln(1 + len(match_lines)) + 1.5 * contains(lower(text), lower(['license', 'token', 'MIT'][query_index + 1]))::INT AS score FROM sp)"""
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_table(docs, F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def lined(spark: SparkSession, sf_dir: str, options: Options = ALL) -> DataFrame:
    return match.with_lines(corpus(spark, sf_dir), options)


def scouted(spark: SparkSession, sf_dir: str, patterns: list[str], options: Options = ALL) -> tuple[DataFrame, list]:
    queries = compile_patterns(spark, patterns, options)
    return match.candidates(match.scout(lined(spark, sf_dir, options), queries, options.comments_only), queries), queries


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the windows of three patterns' matches. The tables hold prose, so the declaration tables are empty."""
    files, queries = scouted(spark, sf_dir, THREE)
    return regions.windows(with_declarations(match.attributed(files, queries, None)), queries, ALL)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned regions of three patterns."""
    found = regions.merge(windowed(spark, sf_dir), 3)
    return regions.owned(found.select("path", "lines", F.explode("regions").alias("r")).select("path", "lines", "r.*"), 3)


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(f"WITH {LINES} SELECT path, line_no, text FROM l")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.line_table(lined(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str, pattern: str, options: Options) -> DataFrame:
    files, queries = scouted(spark, sf_dir, [pattern], options)
    return files.select("path", F.explode(match.matching_lines("shown", queries[0].regex)).alias("line_no"))


@query(f"WITH {LINES} SELECT path, line_no FROM l WHERE regexp_matches(text, 'th[aeo]r+[a-z]* o')")
def regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, "th[aeo]r+[a-z]* o", ALL)


@query(f"WITH {LINES} SELECT path, line_no FROM l WHERE contains(text, '***')")
def literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, "***", Options(max_tokens=None, literal=True))


@query(f"WITH {LINES} SELECT path, line_no FROM l WHERE contains(lower(text), 'license')")
def ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, "LICENSE", FREE)


@query(rf"WITH {LINES} SELECT path, line_no FROM l WHERE regexp_matches(text, '(?:^|[^0-9_\pL\pM])(?:of the)(?:$|[^0-9_\pL\pM])')")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, "of the", Options(max_tokens=None, word=True))


@query(f"WITH {LINES} SELECT path, least(count(*), 512)::INT AS match_count FROM l WHERE regexp_matches(text, 'license|token|MIT') GROUP BY path")
def multi_pattern_scout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scouted(spark, sf_dir, THREE)[0].select("path", "match_count")


@query(f"WITH {MATCHES} SELECT path, line, q::INT AS q FROM m")
def pattern_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, queries = scouted(spark, sf_dir, THREE)
    return match.attributed(files, queries, None).select("path", F.explode("matches").alias("m")).select("path", "m.line", "m.q")


@query(f"WITH {LINES} SELECT path, line_no AS line FROM l WHERE contains(text, 'e') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 16")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, queries = scouted(spark, sf_dir, ["e"])
    return match.attributed(files, queries, T.HINT_LINES).select("path", F.explode("matches").alias("m")).select("path", "m.line")


#: A name in one of four styles, from the words of a column.
STYLED = """styled AS (SELECT DISTINCT p_partkey % 4 AS style, string_split(p_name, ' ') AS words, p_size::VARCHAR AS num FROM part),
 named AS (SELECT *, CASE style WHEN 0 THEN array_to_string(list_transform(words, lambda w: upper(w[1]) || w[2:]), '') || num WHEN 1 THEN words[1] || array_to_string(list_transform(words[2:], lambda w: upper(w[1]) || w[2:]), '') || num || 'Id'
   WHEN 2 THEN upper(words[1]) || upper(words[2][1]) || words[2][2:] || '-' || num ELSE '__' || array_to_string(words, '_') || '__' || num END AS name,
   CASE style WHEN 0 THEN list_append(words, num) WHEN 1 THEN list_concat(words, [num, 'id']) WHEN 2 THEN [words[1], words[2], num] ELSE list_append(words, num) END AS parts FROM styled)"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 4).alias("style"), F.split("p_name", " ").alias("words"), F.col("p_size").cast("string").alias("num")).distinct()
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))
    titled = F.transform("words", title)
    first, second = F.element_at("words", 1), F.element_at("words", 2)
    rest = F.array_join(F.slice(titled, F.lit(2), F.size(titled)), "")
    styles = [F.concat(F.array_join(titled, ""), "num"), F.concat(first, rest, "num", F.lit("Id")), F.concat(F.upper(first), title(second), F.lit("-"), "num"), F.concat(F.lit("__"), F.array_join("words", "_"), F.lit("__"), "num")]
    return part.select(F.coalesce(*(F.when(F.col("style") == k, x) for k, x in enumerate(styles))).alias("name"))


@query(f"WITH {STYLED} SELECT name, array_to_string(parts, ',') AS parts FROM named")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel, Pascal, acronym, kebab and snake names with digits."""
    return styled(spark, sf_dir).select("name", F.array_join(X.identifier_parts(F.col("name")), ",").alias("parts"))


@query(f"WITH {STYLED} SELECT name, array_to_string(CASE WHEN style = 2 THEN [words[1], words[2], words[1] || words[2], num, 'x'] ELSE list_append(list_append(parts, lower(name)), 'x') END, ',') AS terms FROM named WHERE num = '7'")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of patterns: parts first, then the whole, each once. Patterns are few and split where they are given."""
    names = [r[0] for r in styled(spark, sf_dir).filter(F.col("name").rlike(r"(?<![0-9])7(?:Id)?$")).collect()]
    return spark.createDataFrame([(n, ",".join(X.query_terms(f"{n}[.]x {n}"))) for n in names], "name string, terms string")


@query(f"WITH {DOCS} SELECT path, CASE WHEN regexp_matches(path, '/doc_7[.]txt$') THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM docs")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, X.query_terms("doc_7")[0::3] + ["doc_7"]))
    return corpus(spark, sf_dir).select("path", X.path_score(F.col("path"), terms).alias("score"))


NAMED = "named AS (SELECT doc_id, ['src/tests/', 'lib/', 'spec/models/', 'app/contest/'][(doc_id % 4 + 1)::INT] || ['api', 'auth_test', 'test_auth', 'AuthTests', 'latest', 'api.test', 'Spec', 'x'][(doc_id % 8 + 1)::INT] || ['.py', '.RS', '.ts', '.cs', ''][(doc_id % 5 + 1)::INT] AS path FROM documents)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    path = F.concat(at(["src/tests/", "lib/", "spec/models/", "app/contest/"]), at(["api", "auth_test", "test_auth", "AuthTests", "latest", "api.test", "Spec", "x"]), at([".py", ".RS", ".ts", ".cs", ""]))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path.alias("path"), F.lit("x").alias("content"))


@query(f"WITH {NAMED} SELECT doc_id, path FROM named WHERE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('py', 'pyi', 'rs')")
def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.path_filters(named(spark, sf_dir), Options(langs=("py", "rust"))).select("doc_id", "path")


@query(f"WITH {NAMED} SELECT doc_id, path, path LIKE 'src/tests/%' OR path LIKE 'spec/%' OR regexp_matches(path, '/(auth_test|test_auth|AuthTests|api[.]test|Spec)([.][A-Za-z]+)?$') AND NOT regexp_matches(path, '/api[.]test$') AS is_test FROM named")
def test_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("doc_id", "path", X.looks_like_test(F.col("path")).alias("is_test"))


@query(f"WITH {NAMED} SELECT doc_id, path FROM named WHERE (path LIKE '%.py' OR path LIKE '%.ts') AND path NOT LIKE 'lib/%'")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.path_filters(named(spark, sf_dir), Options(globs=("*.py", "*.ts", "!lib/**"))).select("doc_id", "path")


@query(f"WITH {DOCS}, wanted AS (SELECT 'src' || s || '/en/doc_' || i || '.txt' AS path FROM range(20) a(s), range(300) b(i) WHERE (s + i) % 3 = 0) SELECT path FROM docs SEMI JOIN wanted USING (path)")
def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given list, with repeats, other spellings and paths that aren't there."""
    wanted = [f"src{s}/en/doc_{i}.txt" for s in range(20) for i in range(300) if (s + i) % 3 == 0]
    return keep_paths(corpus(spark, sf_dir).select("path"), ["./" + p for p in wanted] + wanted + ["not/there.txt"])


@query(f"WITH {LINES} SELECT path, count(*)::INT AS match_count, row_number() OVER (ORDER BY count(*) DESC, path)::INT AS candidate_rank FROM l WHERE regexp_matches(text, 'license|token|MIT') GROUP BY path QUALIFY candidate_rank <= 256")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scouted(spark, sf_dir, THREE)[0].select("path", "declaration_hint", "match_count", "best_path").orderBy(*match.candidate_order()).limit(T.CHUNK)
    return files.select("path", "match_count", F.row_number().over(Window.orderBy(*match.candidate_order())).alias("candidate_rank"))


@query(f'WITH {WINDOWS} SELECT path, line, q::INT AS q, s AS "start", e AS "end" FROM w')
def orphan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).select("path", F.explode("windows").alias("w")).select("path", "w.line", "w.q", "w.start", "w.end")


@query(f'WITH {ISLANDS} SELECT path, s AS "start", e AS "end", array_to_string(list_sort(list_distinct(lines)), \',\') AS matched, q0::INT AS q0, q1::INT AS q1, q2::INT AS q2 FROM c')
def region_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regions.collapse(windowed(spark, sf_dir), 3).select("path", F.explode("parts").alias("p")).select("path", "p.*")
    return out.select("path", "start", "end", joined("match_lines").alias("matched"), *(F.col("per_query")[i].alias(f"q{i}") for i in range(3)))


@query(f"WITH {ISLANDS} SELECT path, start_line, end_line, array_to_string(match_lines, ',') AS match_lines FROM r")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), joined("match_lines").alias("match_lines"))


@query(f"WITH {ISLANDS} SELECT path, start_line, query_index::INT AS query_index, array_to_string(list_filter([0, 1, 2], lambda i: [q0, q1, q2][i + 1] > 0), ',') AS answered FROM o")
def region_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("path", F.col("start").alias("start_line"), "query_index", joined("answered").alias("answered"))


ASKED = ["license", "zebra-crossing", "token", "Lorem ipsum", "MIT", "the"]


@query(f"WITH {LINES}, p AS (SELECT unnest({ASKED}) AS pattern) SELECT pattern FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE contains(text, pattern))")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(corpus(spark, sf_dir), ASKED, ALL)
    return spark.createDataFrame([(p,) for p in found.unmatched], "pattern string")


@query(f"WITH {ISLANDS} SELECT path, start_line, text FROM sp")
def span_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("path", F.col("start").alias("start_line"), regions.span_text(F.col("lines"), F.col("start"), F.col("end")).alias("text"))


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    files, queries = scouted(spark, sf_dir, THREE)
    return rank.shadowed(extract(files, queries, ALL)), queries


@query(f"WITH {ISLANDS} SELECT path, start_line, round(ln(1 + len(match_lines)), 6) AS matches, 1.5 * contains(lower(text), lower(['license', 'token', 'MIT'][query_index + 1]))::INT::DOUBLE AS terms, round(score, 6) AS score FROM sc")
def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)[0].select("path", "start_line", F.round("why.matches", 6).alias("matches"), F.col("why.terms").alias("terms"), F.round("score", 6).alias("score"))


RANKED = "row_number() OVER (ORDER BY round(score, 9) DESC, path, start_line)"


@query(f"WITH {ISLANDS} SELECT path, start_line, end_line, {RANKED} AS place FROM sc")
def span_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every span in the final order, however many there are."""
    found = spans(spark, sf_dir)[0].withColumn("score", F.round("score", 9))
    return rank.placed(found, [], rank.span_order(), "place").select("path", "start_line", "end_line", "place")


@query(f"WITH {ISLANDS} SELECT path, start_line, query_index::INT AS query_index, row_number() OVER (PARTITION BY query_index ORDER BY round(score, 9) DESC, path, start_line)::INT AS lane FROM sc")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.interleaved(spans(spark, sf_dir)[0].withColumn("score", F.round("score", 9)), 3).select("path", "start_line", "query_index", F.col("lane").cast("int").alias("lane"))


@query(f"WITH {ISLANDS} SELECT path, start_line, end_line, text FROM sc QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, start_line) <= 2")
def per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)[0].withColumn("score", F.round("score", 9))
    return pack.capped(found, 2, rank.span_order()).select("path", "start_line", "end_line", "text")


#: Files of the ranked lists below: sources; costs: characters.
COSTED = "d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, source AS path, (n_chars // 4)::BIGINT AS cost, doc_id % 3 <> 0 AS decl FROM documents)"


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.col("source").alias("path"), F.floor(F.col("n_chars") / 4).alias("tokens"), (F.col("doc_id") % 3 != 0).alias("is_declaration"))


def filling(cap: int, most: int, floor: int, shown: str) -> str:
    return f"WITH RECURSIVE {COSTED}, src AS (SELECT n AS place, doc_id, path, cost AS tokens, decl AS is_declaration FROM d), {filled('src', most, cap, floor)} SELECT {shown} FROM src JOIN taken USING (place)"


@query(filling(3, 9000, 0, "doc_id, path, tokens"))
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(costed(spark, sf_dir), 9000, 3, 0, [F.asc("doc_id")]).select("doc_id", "path", "tokens")


@query(filling(3, 9000, 12, "doc_id, path, tokens, is_declaration"))
def min_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(costed(spark, sf_dir), 9000, 3, 12, [F.asc("doc_id")]).select("doc_id", "path", "tokens", "is_declaration")


@query(f"""WITH {COSTED}, b AS (SELECT doc_id, path, cost, (n - 1) // 8 AS batch, n % 2 AS q FROM d),
        s AS (SELECT batch, q, sum(cost) AS c FROM b GROUP BY ALL),
        g AS (SELECT x.batch, y.q, sum(coalesce(c, 0)) OVER (PARTITION BY y.q ORDER BY x.batch) AS total FROM (SELECT DISTINCT batch FROM b) x CROSS JOIN (VALUES (0), (1)) y(q) LEFT JOIN s ON s.batch = x.batch AND s.q = y.q),
        f AS (SELECT min(batch) AS stop FROM (SELECT batch FROM g GROUP BY batch HAVING min(total) >= 16000))
        SELECT doc_id, cost AS tokens FROM b, f WHERE stop IS NULL OR batch <= stop""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank.placed(costed(spark, sf_dir), [], [F.asc("doc_id")], "candidate_rank")
    ranked = ranked.withColumn("query_index", (F.col("candidate_rank") % 2).cast("int"))
    return pack.budget_gate(ranked, 2, 8000).select("doc_id", "tokens")


@query(f"WITH {LINES}, x AS (SELECT path, line_no, (line_no - 1) // 10 AS k FROM l WHERE contains(text, 'the')) SELECT path, line_no, CASE WHEN line_no <= 10 * k + 7 THEN 'part_' || k END AS name, CASE WHEN line_no <= 10 * k + 7 THEN 10 * k + 1 END AS start_line FROM x")
def asof_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = match.line_table(lined(spark, sf_dir))
    k = F.floor((F.col("line_no") - 1) / 10)
    decls = lines.filter("line_no % 10 = 1").select("path", F.concat(F.lit("part_"), k).alias("name"), F.lit("part").alias("kind"), F.col("line_no").alias("start_line"), (F.col("line_no") + 6).alias("end_line"), F.lit(0).alias("depth"))
    return regions.asof_join(lines.filter(F.col("text").contains("the")), decls).select("path", "line_no", "name", "start_line")


@query(f"WITH {LINES}, x AS (SELECT path, line_no AS line, strlen(text[:strpos(text, 'token') - 1]) + 1 AS col, text FROM l WHERE contains(text, 'token')) SELECT *, 'top/' || path || ':' || line || ':' || col || ':' || text AS rendered FROM x")
def vimgrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(corpus(spark, sf_dir), ["token"], Options(max_tokens=None, columns=True))
    return render.vimgrep(found.spans, "top").select("path", "line", "col", "text", "rendered")


@query(f"WITH {ISLANDS} SELECT path, start_line, end_line, query, is_declaration FROM (SELECT *, ['license', 'token', 'MIT'][query_index + 1] AS query, false AS is_declaration FROM sc)")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.json_rows(search(corpus(spark, sf_dir), THREE, ALL).spans)
    return rows.select(F.from_json("json", "path string, start_line bigint, end_line bigint, query string, is_declaration boolean").alias("x")).select("x.*")


@query(f"WITH {DOCS} SELECT path, len(regexp_extract_all(content, '{T.TOKEN_PIECES.replace(chr(39), chr(39) * 2)}')) AS pieces FROM docs")
def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", X.token_pieces(F.col("content")).alias("pieces"))


#: Where white space of several characters stands before a digit, its last character is a piece of its own; before other signs too, if it is no space.
SPACED = DOCS + ", sp AS (SELECT path, replace(replace(content, ' a', '   7'), ' e', ' ' || chr(9) || '!') AS content FROM docs)"


@query(f"WITH {SPACED} SELECT path, len(regexp_extract_all(content, '{T.TOKEN_PIECES.replace(chr(39), chr(39) * 2)}')) + len(regexp_extract_all(content, '[ \\t]{{2,}}\\pN')) + len(regexp_extract_all(content, '[ \\t]*[ \\t]\\t[^\\s\\pL\\pN]')) AS pieces FROM sp")
def token_pieces_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published split with its look-ahead."""
    spaced = F.replace(F.replace("content", F.lit(" a"), F.lit("   7")), F.lit(" e"), F.lit(" \t!"))
    return corpus(spark, sf_dir).select("path", X.token_pieces(spaced, exact=True).alias("pieces"))


@query(f"WITH {DOCS}, n AS (SELECT path, strlen(content) - len(regexp_extract_all(content, 'th')) - len(regexp_extract_all(content, 'the')) AS tokens FROM docs) SELECT path, tokens, least(tokens, 100) AS capped FROM n")
def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts by a vocabulary: all bytes, and two merges."""
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257}
    files = corpus(spark, sf_dir)
    return files.select("path", X.bpe_counter(ranks)("content").alias("tokens"), X.bpe_counter(ranks, 100)("content").alias("capped"))


ENDS = DOCS + ", ends AS (SELECT path, replace(replace(replace(content, ' a', chr(13) || chr(13) || chr(10) || 'a'), ' e', chr(13) || chr(10) || 'e'), ' i', chr(13) || 'i') || chr(13) AS content FROM docs)"


@query(f"WITH {ENDS}, s AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x: CASE WHEN ends_with(x, chr(13)) THEN x[:-2] ELSE x END) AS x FROM ends) SELECT path, unnest(x) AS text, generate_subscripts(x, 1) AS line_no FROM s")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One carriage return goes at a line's end, others stay, and a lone one parts no lines."""
    files = corpus(spark, sf_dir)
    for old, new in ((" a", "\r\r\na"), (" e", "\r\ne"), (" i", "\ri")):
        files = files.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    return match.line_table(match.with_lines(files.withColumn("content", F.concat("content", F.lit("\r"))), ALL))


ODD = LINES.replace("docs AS (SELECT source", "docs AS (SELECT source", 1).replace("text AS content", "replace(replace(replace(text, ' m', chr(8232) || 'm'), ' d', ' δ'), ' s', chr(133) || 's') AS content")
#: Patterns of the same meaning in SQL's engine.
DIALECT = ["(?P<first>[[:upper:]])[[:lower:]]+.m", r"\p{Greek}[a-z]{3}", "e.s", r"(?i)THE\x20[[:^digit:]]", r"^[A-Z][^\x20]*[!-/]?\pL+", r"[[:alpha:]]s[.]$"]


@query(f"WITH {ODD}, p AS (SELECT unnest({DIALECT}) AS pattern) SELECT pattern, path, line_no FROM l, p WHERE regexp_matches(text, pattern)".replace("\\\\", "\\"))
def regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket classes, scripts, named groups, dots and ends of lines beside odd separators."""
    files = corpus(spark, sf_dir)
    for old, new in ((" m", "\u2028m"), (" d", " δ"), (" s", "\u0085s")):
        files = files.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    out = None
    for pattern in DIALECT:
        queries = compile_patterns(spark, [pattern], ALL)
        found = match.scout(match.with_lines(files, ALL), queries)
        one = found.select(F.lit(pattern).alias("pattern"), "path", F.explode("found").alias("line_no"))
        out = one if out is None else out.unionByName(one)
    return out


SAME = "docs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'same.txt' WHEN 1 THEN source || '.txt' END AS path, text AS content FROM documents WHERE text <> '')"


@query(f"""WITH {SAME}, ls AS (SELECT doc_id, path, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS lines FROM (SELECT doc_id, path, string_split_regex(content, '\\r?\\n') AS s FROM docs)),
        l AS (SELECT doc_id, path, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_no, len(lines) AS total FROM ls),
        w AS (SELECT doc_id, path, line_no AS line, greatest(1, line_no - 2) AS s, least(line_no + 2, total) AS e FROM l WHERE regexp_matches(text, 'the|token')),
        f AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM w),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
        r AS (SELECT doc_id, path, min(s) AS start_line, max(e) AS end_line, list_sort(list(DISTINCT line)) AS m FROM g GROUP BY doc_id, path, island)
        SELECT r.path, start_line, end_line, array_to_string(m, ',') AS match_lines, array_to_string(lines[start_line:end_line], chr(10)) AS text FROM r JOIN ls USING (doc_id)""".replace("\\\\", "\\"))
def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a path, or have none, are files of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.when(F.col("doc_id") % 3 == 0, "same.txt").when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(".txt")))
    found = search(from_table(docs, path), ["the|token"], Options(max_tokens=None, orphan_context=2))
    return found.spans.select("path", "start_line", "end_line", joined("match_lines").alias("match_lines"), "text")


@query(f"WITH {ISLANDS} SELECT path, start_line, end_line, array_to_string(match_lines, ',') AS match_lines, ['license', 'token', 'MIT'][query_index + 1] AS query, round(score, 6) AS score, text FROM sc")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), THREE, ALL).spans.select("path", "start_line", "end_line", joined("match_lines").alias("match_lines"), "query", F.round("score", 6).alias("score"), "text")


@query(f"""WITH RECURSIVE {ISLANDS}, mc AS (SELECT path, row_number() OVER (ORDER BY least(count(DISTINCT line), 512) DESC, path) AS candidate_rank FROM m GROUP BY path),
        ts AS (SELECT sc.*, len(regexp_extract_all(text, '{T.TOKEN_PIECES.replace(chr(39), chr(39) * 2)}'))::BIGINT AS tokens, (candidate_rank - 1) // 8 AS batch FROM sc JOIN mc USING (path)),
        su AS (SELECT batch, query_index, sum(tokens) AS t FROM ts GROUP BY ALL),
        gr AS (SELECT x.batch, q, sum(coalesce(t, 0)) OVER (PARTITION BY q ORDER BY x.batch) AS total FROM (SELECT DISTINCT batch FROM ts) x CROSS JOIN range(3) y(q) LEFT JOIN su ON su.batch = x.batch AND su.query_index = q),
        ha AS (SELECT min(batch) AS stop FROM (SELECT batch FROM gr GROUP BY batch HAVING min(total) >= 5333)),
        la AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY round(score, 9) DESC, path, start_line) AS lane FROM ts, ha WHERE stop IS NULL OR batch <= stop),
        src AS (SELECT *, row_number() OVER (ORDER BY lane, query_index) AS place, false AS is_declaration FROM la), {filled("src", 4000, 3)}
        SELECT path, start_line, end_line, ['license', 'token', 'MIT'][query_index + 1] AS query, tokens, round(score, 6) AS score FROM src JOIN taken USING (place)""")
def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), THREE, Options(max_tokens=4000)).spans.select("path", "start_line", "end_line", "query", "tokens", F.round("score", 6).alias("score"))


RANKS = "ranked AS (SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank, lang || (doc_id % 5) AS path, (n_chars // 4)::BIGINT AS cost FROM documents)"


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("query"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.concat("lang", (F.col("doc_id") % 5).cast("string")).alias("path"), F.floor(F.col("n_chars") / 4).alias("cost"))


@query(f"""WITH {RANKS}, a AS (SELECT query, path, min(rank) AS r FROM ranked GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r) AS place FROM a)
        SELECT q.query, coalesce(1.0 / place, 0.0)::DOUBLE AS mrr FROM (SELECT DISTINCT query FROM ranked) q LEFT JOIN b ON b.query = q.query AND path = 'fr2'""")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranks(spark, sf_dir)
    return metrics.mrr(ranked, ranked.select("query").distinct().withColumn("path", F.lit("fr2")))


@query(f"""WITH RECURSIVE {RANKS}, n AS (SELECT query, max(rank) AS last FROM ranked GROUP BY 1), t AS (
        SELECT query, 0 AS rank, 0::BIGINT AS used, []::VARCHAR[] AS kept FROM n UNION ALL
        SELECT r.query, r.rank, CASE WHEN ok THEN r.used + cost ELSE r.used END, CASE WHEN ok THEN list_append(kept, path) ELSE kept END
        FROM (SELECT ranked.*, t.used, t.kept, NOT list_contains(t.kept, path) AND t.used + cost <= 5000 AS ok FROM t JOIN ranked ON ranked.query = t.query AND ranked.rank = t.rank + 1) r),
        k AS (SELECT query, unnest(kept) AS path FROM t JOIN n USING (query) WHERE rank = last),
        v AS (SELECT DISTINCT query, path FROM ranked)
        SELECT v.query, count(k.path)::DOUBLE / count(*) AS coverage FROM v LEFT JOIN k ON k.query = v.query AND k.path = v.path GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranks(spark, sf_dir)
    return metrics.coverage(metrics.under_budget(ranked, 5000), ranked.select("query", "path"))


@query("SELECT round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, round(stddev_samp(n_chars), 6) AS stddev FROM documents")
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars")
    return out.select(F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"))


@query("""WITH m AS (SELECT 's' || l_partkey AS symbol, 'p' || l_suppkey AS path, l_quantity > 49 AS d FROM lineitem),
        i AS (SELECT symbol, coalesce(list_sort(list(DISTINCT path) FILTER (d)), []) AS defs, coalesce(list_sort(list(DISTINCT path) FILTER (NOT d)), []) AS refs FROM m GROUP BY 1)
        SELECT symbol, defs[1] AS path, len(refs)::INT AS n_references FROM i WHERE len(defs) = 1 AND len(list_filter(refs, lambda x: x <> defs[1])) > 0""")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mentions = items.select(F.concat(F.lit("s"), "l_partkey").alias("symbol"), F.concat(F.lit("p"), "l_suppkey").alias("path"), (F.col("l_quantity") > 49).alias("is_definition"))
    index = metrics.symbol_index(mentions)
    return metrics.query_symbols(index).join(index, "symbol").select("symbol", "path", F.size("references").alias("n_references"))


#: A small code corpus for what prose cannot show.
CODE = {
    "src/auth.py": 'import db\n\n\n# checks a token\ndef validate_token(token):\n    return db.find(token)\n\n\ndef refresh(token):\n    """def fake():"""\n    return validate_token(token)\n',
    "src/api.py": "from auth import validate_token\n\n\ndef handler(request):\n    if not validate_token(request.token):\n        raise ValueError\n    return 1\n",
    "vendor/copy.py": "class Copy:\n    def validate_token(self, token):\n        return token\n",
    "src/lib.rs": "#[derive(Debug)]\npub struct Repo<T> {\n    db: T, // the store\n}\n\nimpl<T> Repo<T> {\n    pub fn save(&self) {\n        validate_token(self.db)\n    }\n}\n",
    "web/app.ts": "export class App {\n  load = (id) => {\n    return fetch(id)\n  }\n}\n/* block\n   comment on validate_token */\nexport default function start() {\n}\n",
}


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODE.items()), "path string, content string")


@query("""SELECT * FROM (VALUES ('src/api.py', 'handler', 'def', 4::BIGINT, 7::BIGINT, 0), ('src/auth.py', 'refresh', 'def', 9, 11, 0), ('src/auth.py', 'validate_token', 'def', 5, 6, 0),
        ('src/lib.rs', 'Repo', 'impl', 6, 6, 0), ('src/lib.rs', 'Repo', 'struct', 2, 4, 0), ('src/lib.rs', 'save', 'fn', 7, 9, 1), ('vendor/copy.py', 'Copy', 'class', 1, 1, 0), ('vendor/copy.py', 'validate_token', 'def', 2, 3, 1),
        ('web/app.ts', 'App', 'class', 1, 1, 0), ('web/app.ts', 'load', 'function', 2, 4, 1), ('web/app.ts', 'start', 'function', 8, 9, 0)) v(path, name, kind, start_line, end_line, depth)""")
def declaration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_declarations(code(spark)).select("path", F.explode("decls").alias("d")).select("path", "d.*")


LINE_CASES = ["def plain():", "pub fn two() {", "export default function three() {", "x = 1", "class Four(Base):", "async def five():", "from enum import Enum", "struct Six {", "total = compute(x)", "interface Seven {"]


@query("SELECT line, nullif(regexp_extract(line, '^\\s*(?:(?:pub|export|default|async)\\s+)*(?:class|def|fn|function|struct|interface)\\s+([A-Za-z_]\\w*)', 1), '') AS name FROM (VALUES " + ", ".join(f"('{x}')" for x in LINE_CASES) + ") v(line)")
def keyword_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in LINE_CASES], "line string")
    return lines.select("line", declared_names(F.array("line"))[0].alias("name"))


@query("SELECT * FROM (VALUES ('src/auth.py:5-6'), ('src/auth.py:1-11')) v(anchor) WHERE false")
def comments_only_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that only a docstring holds is in no comment."""
    found = search(code(spark), ["fake"], Options(comments_only=True))
    return found.spans.select(fetch.anchor(F.col("path"), F.col("start_line"), F.col("end_line")).alias("anchor"))


@query("SELECT 'web/app.ts:1-9' AS anchor, '7' AS match_lines")
def comments_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(code(spark), ["validate_token"], Options(comments_only=True))
    return found.spans.select(fetch.anchor(F.col("path"), F.col("start_line"), F.col("end_line")).alias("anchor"), joined("match_lines").alias("match_lines"))


@query("SELECT * FROM (VALUES ('src/auth.py:5-6', true, 2.193147::DOUBLE), ('vendor/copy.py:2-3', true, 1.193147), ('src/api.py:1-7', false, 2.598612), ('src/auth.py:9-11', false, 2.193147), ('src/lib.rs:7-9', false, 2.193147), ('web/app.ts:1-9', false, 2.193147)) v(anchor, is_declaration, score)")
def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden: declarations first, a copy one level deeper loses a point, an import's window merges with the function it meets."""
    found = search(code(spark), ["validate_token"], Options(word=True, max_tokens=1000))
    return found.spans.select(fetch.anchor(F.col("path"), F.col("start_line"), F.col("end_line")).alias("anchor"), "is_declaration", F.round("score", 6).alias("score"))


@query("SELECT * FROM (VALUES ('src/lib.rs:2-4', 'struct')) v(anchor, kind)")
def select_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(code(spark), ["Repo"], Options(kinds=("struct", "class")))
    return found.spans.select(fetch.anchor(F.col("path"), F.col("start_line"), F.col("end_line")).alias("anchor"), "kind")


@query("""WITH s AS (SELECT 'sym' || (doc_id % 50) AS symbol, doc_id, (n_chars % 7)::INT AS depth, doc_id % 3 > 0 AS decl FROM documents)
        SELECT doc_id, CASE WHEN decl THEN (depth - min(depth) FILTER (decl) OVER (PARTITION BY symbol))::DOUBLE ELSE 0.0 END AS penalty FROM s""")
def shadow_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("sym"), F.col("doc_id") % 50).alias("symbol"), (F.col("n_chars") % 7).cast("int").alias("depth"), (F.col("doc_id") % 3 > 0).alias("is_declaration"))
    docs = docs.withColumn("why", F.struct(zero.alias("matches"), zero.alias("terms"), zero.alias("path"), zero.alias("depth_penalty")))
    return rank.shadowed(docs).select("doc_id", F.col("why.depth_penalty").alias("penalty"))


@query(f"WITH {DOCS}, t AS (SELECT path, lower(replace(content, ' w', ' ΟΔΟΣ ')) AS t FROM docs) SELECT path, (contains(t, 'οδοσ')::INT + contains(t, 'token')::INT + contains(t, 'the')::INT) / 3.0::DOUBLE AS overlap FROM t")
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of terms that a text holds, by letters in lower case."""
    text = F.replace("content", F.lit(" w"), F.lit(" ΟΔΟΣ "))
    return corpus(spark, sf_dir).select("path", X.term_overlap(text, F.array(*map(F.lit, ("οδοσ", "token", "the")))).alias("overlap"))
