"""Scores and orders of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.durable import cut
from ..plans.patterns import Query


def per_query(queries: list[Query], value) -> Column:
    """value(query) of a row's own query."""
    return F.coalesce(*(F.when(F.col("query_index") == q.index, value(q)) for q in queries))


def scored(spans: DataFrame, queries: list[Query]) -> DataFrame:
    """With why: the parts of the score, the depth penalty still 0."""
    matches = F.lit(T.WEIGHTS["matches"]) * F.log(F.size("match_lines") + F.lit(1.0))
    terms = per_query(queries, lambda q: F.lit(T.WEIGHTS["terms"]) * X.term_overlap(F.col("text"), F.array(*map(F.lit, q.terms)).cast("array<string>")))
    path = F.lit(T.WEIGHTS["path"]) * F.element_at("path_scores", F.col("query_index") + 1)
    return spans.withColumn("why", F.struct(matches.alias("matches"), terms.alias("terms"), path.alias("path"), F.lit(0.0).alias("depth_penalty")))


def shadowed(spans: DataFrame) -> DataFrame:
    """Declarations lose a point for each level below the shallowest one of their symbol."""
    least = spans.filter("is_declaration and symbol is not null").groupBy("symbol").agg(F.min("depth").alias("least"))
    spans = spans.join(least, "symbol", "left")
    penalty = F.when(F.col("is_declaration") & F.col("least").isNotNull(), T.WEIGHTS["depth"] * (F.col("depth") - F.col("least"))).otherwise(0.0)
    spans = spans.withColumn("why", F.col("why").withField("depth_penalty", penalty)).drop("least")
    w = F.col("why")
    return spans.withColumn("score", w["matches"] + w["terms"] + w["path"] - w["depth_penalty"])


def span_order() -> list[Column]:
    return [F.desc("is_declaration"), F.desc("score"), F.asc("path"), F.asc("start_line")]


def placed(rows: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """rows with out, each one's place (from 1) within its group by a total order; a group may be of any size.

    Rows are dealt by range and numbered within their part; the parts' counts, a row for each part and group, give what
    comes before. The dealing is checkpointed, so that numbers and counts see the same parts.
    """
    parts = cut(rows.repartitionByRange(*map(F.asc, groups), *order).withColumn("__sl_part", F.spark_partition_id()))
    counts = parts.groupBy("__sl_part", *groups).agg(F.count("*").alias("__sl_n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__sl_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__sl_base", F.coalesce(F.sum("__sl_n").over(before), F.lit(0))).drop("__sl_n")
    within = F.row_number().over(Window.partitionBy("__sl_part", *groups).orderBy(*order))
    met = parts.withColumn(out, within).join(bases, ["__sl_part", *groups])
    return met.withColumn(out, F.col(out) + F.col("__sl_base")).drop("__sl_part", "__sl_base")


def interleaved(spans: DataFrame, n_queries: int, bounded: bool = False) -> DataFrame:
    """With lane, a span's rank within its query; order by (lane, query_index). One query needs no lanes.

    bounded: the spans are few, as a budget makes them, and one window may hold a lane.
    """
    if n_queries == 1:
        return spans.withColumn("lane", F.lit(0))
    if bounded:
        return spans.withColumn("lane", F.row_number().over(Window.partitionBy("query_index").orderBy(*span_order())))
    return placed(spans, ["query_index"], span_order(), "lane")


def output_order(n_queries: int) -> list[Column]:
    return span_order() if n_queries == 1 else [F.asc("lane"), F.asc("query_index")]
