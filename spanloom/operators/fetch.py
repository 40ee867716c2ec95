"""Reading anchors (path:start-end) back."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from .pack import fill
from .regions import span_text

ANCHOR = re.compile(r"(.+):\s*(\d+)\s*-\s*(\d+)\s*", re.S)


def anchor(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def parse_anchor(text: str) -> tuple[str, int, int]:
    """From the right, so paths may hold colons."""
    m = ANCHOR.fullmatch(text.strip())
    if not m or not 1 <= int(m[2]) <= int(m[3]):
        raise ValueError(f"not an anchor: {text}")
    return m[1], int(m[2]), int(m[3])


def anchors_from(text: str) -> list[str]:
    """The first word of each line that has one."""
    return [x.split()[0] for x in text.split("\n") if x.split()]


def contained(path: str) -> str:
    """A path below the root; absolute and escaping ones are refused."""
    clean = posixpath.normpath(path)
    if posixpath.isabs(path) or clean == ".." or clean.startswith("../"):
        raise ValueError(f"outside the root: {path}")
    return clean


def fetch(corpus: DataFrame, anchors: list[str], max_tokens: int | None = T.MAX_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """A span for each anchor in the given order, repeats kept; what is over the budget is passed over.

    An anchor that is no anchor, leaves the root or names no line there raises, and nothing is returned.
    """
    spark = corpus.sparkSession
    parsed = [(i, contained(p), s, e) for i, (p, s, e) in enumerate(map(parse_anchor, anchors))]
    wanted = spark.createDataFrame(parsed, "ordinal int, path string, start_line bigint, end_line bigint")
    paths = wanted.select("path").distinct()
    paths = F.broadcast(paths) if len(parsed) <= T.FEW else paths
    files = corpus.select("path", "content").join(paths, "path", "left_semi").withColumn("lines", X.lines(F.col("content")))
    total = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    met = wanted.join(files, "path", "left").withColumn("end_line", F.least("end_line", total))
    lost = met.filter(F.col("content").isNull() | (F.col("start_line") > F.col("end_line"))).orderBy("ordinal").first()
    if lost:
        raise ValueError(f"no such lines: {anchors[lost['ordinal']]}")
    met = met.withColumn("text", span_text(F.col("lines"), F.col("start_line"), F.col("end_line")))
    met = met.withColumn("tokens", X.bpe_counter(vocabulary)("text") if vocabulary else X.token_pieces(F.col("text")))
    if max_tokens is not None:
        rows = met.orderBy("ordinal").select("ordinal", "path", "tokens").collect()  # a row for each anchor given
        kept = [rows[i]["ordinal"] for i in fill([(str(r["ordinal"]), r["tokens"], False) for r in rows], max_tokens, 0)]
        met = met.filter(F.col("ordinal").isin(kept))
    query = anchor(F.col("path"), F.col("start_line"), F.col("end_line"))
    none = [F.lit(None).cast("string").alias(c) for c in ("symbol", "kind")]
    plain = [F.array().cast("array<bigint>").alias("match_lines"), F.lit(False).alias("is_declaration"), F.lit(0).alias("depth")]
    return met.orderBy("ordinal").select(
        "path", "start_line", "end_line", *none, *plain, query.alias("query"), "tokens", F.lit(0.0).alias("score"), "text"
    )
