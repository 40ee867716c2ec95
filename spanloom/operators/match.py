"""Scanning: lines, matches, and what they say about each file. A file is one row; nothing here shuffles its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.declare import comment_lines, declared_names
from ..plans.options import Options
from ..plans.patterns import Query, scout_regex


#: What every line that declares something has.
MAY_DECLARE = rf"\b(?:{'|'.join(sorted(T.KEYWORDS))})\b|[{{=]"


def computed(column: Column) -> Column:
    """column, evaluated once where it stands: a filter on it isn't pushed below, which would evaluate it anew there, as the condition (always true) depends on the task."""
    return F.when(F.spark_partition_id() >= 0, column)


def path_filters(files: DataFrame, options: Options) -> DataFrame:
    """Filters on paths alone, which come before any content is looked at."""
    path = F.col("path")
    if options.globs:
        files = files.filter(X.glob_filter(path, list(options.globs)))
    if options.langs:
        files = files.filter(X.has_extension(path, X.extensions(list(options.langs))))
    if options.tests != "include":
        files = files.filter(X.looks_like_test(path) == F.lit(options.tests == "only"))
    return files


def with_lines(files: DataFrame, options: Options) -> DataFrame:
    """files with lines, the array of their lines, and shown, what patterns are held against."""
    files = files.filter(F.length("content") > 0).withColumn("lines", X.lines(F.col("content")))
    return files.withColumn("shown", comment_lines("content") if options.comments_only else F.col("lines"))


def line_table(files: DataFrame) -> DataFrame:
    """(path, line_no, text) of files with lines."""
    return files.select("path", F.posexplode("lines").alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def matching_lines(shown: Column | str, regex: str) -> Column:
    """The numbers of the lines that match, in order."""
    at = F.transform(shown, lambda x, i: F.when(x.rlike(regex), (i + 1).cast("long")))
    return F.filter(at, lambda n: n.isNotNull())


def first_nul(content: str = "content") -> Column:
    return F.instr(F.col(content), "\0")


def scout(files: DataFrame, queries: list[Query], masked: bool = False) -> DataFrame:
    """Files with a match, with found (line numbers), match_count (capped) and declaration_hint. masked: shown isn't lines.

    A binary file counts only lines before its first NUL; none there, no file. The hint looks at the first lines that
    match, unmasked: does one declare a name that the patterns match?
    """
    regex = scout_regex(queries)
    nul = first_nul()
    before = X.lines(F.substring(F.col("content"), F.lit(1), nul - 1))
    text = F.when(nul == 1, F.array().cast("array<string>")).when(nul > 0, F.zip_with(before, F.slice("shown", 1, F.size(before)), lambda a, b: F.substring(b, F.lit(1), F.length(a)))).otherwise(F.col("shown"))
    # The scan of whole contents is cheap and spares most files the scan by line. What stands at a line's edge, or is blanked in it, can't be told there.
    if not masked and not any(q.anchored for q in queries):
        files = files.filter(F.col("content").rlike(regex))
    files = files.withColumn("found", computed(matching_lines(text, regex))).filter(F.size("found") > 0)
    first = F.transform(F.slice("found", 1, T.HINT_LINES), lambda n: F.element_at("shown", n.cast("int")))
    first = F.filter(first, lambda x: x.rlike(MAY_DECLARE))
    files = files.withColumn("match_count", F.least(F.size("found"), F.lit(T.MATCH_CAP)))
    names = declared_names(first)
    return files.withColumn("names", names).withColumn("declaration_hint", F.exists("names", lambda n: F.coalesce(n.rlike(regex), F.lit(False)))).drop("names")


def candidates(files: DataFrame, queries: list[Query]) -> DataFrame:
    """Scouted files with path_scores, one for each query, and the best of them."""
    scores = F.array(*(X.path_score(F.col("path"), _terms(q)) for q in queries))
    return files.withColumn("path_scores", scores).withColumn("best_path", F.greatest(F.array_max("path_scores"), F.lit(0.0)))


def _terms(q: Query) -> Column:
    return F.array(*map(F.lit, q.terms)).cast("array<string>")


def candidate_order(keyed: bool = False) -> list[Column]:
    return [F.desc("declaration_hint"), F.desc("match_count"), F.desc("best_path"), F.asc("path"), *([F.asc("file_key")] if keyed else [])]


def _tagged(index: int):
    return lambda n: F.struct(n.alias("line"), F.lit(index).alias("q"))


def attributed(files: DataFrame, queries: list[Query], cap: int | None) -> DataFrame:
    """files with matches: (line, q) of every query, each query's capped."""
    each = []
    for q in queries:
        own = matching_lines("shown", q.regex)
        own = F.slice(own, 1, cap) if cap else own
        each.append(F.transform(own, _tagged(q.index)))
    return files.withColumn("matches", computed(F.concat(*each))).filter(F.size("matches") > 0)


def first_columns(queries: list[Query], line: Column) -> Column:
    """The byte column of the first match of any query on a line, 1 for none."""
    at = [F.when(line.rlike(q.regex), X.byte_column(line, q.regex)) for q in queries]
    return F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(1).cast("long"))
