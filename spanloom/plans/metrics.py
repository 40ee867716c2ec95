"""Retrieval metrics and statistics of trials."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mrr(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, mrr) from ranked (query, rank, path) and truth (query, path): 1 / the path's place among distinct paths, else 0."""
    first = ranked.groupBy("query", "path").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    return truth.join(placed, ["query", "path"], "left").groupBy("query").agg(F.max(F.coalesce(1.0 / F.col("place"), F.lit(0.0))).alias("mrr"))


def under_budget(ranked: DataFrame, max_tokens: int) -> DataFrame:
    """(query, path) kept: each path once, greedily, passing over what doesn't fit. A fold over each query's own list."""
    paths = F.sort_array(F.collect_list(F.struct("rank", "path", "cost")))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = ~F.array_contains(s["kept"], x["path"]) & (s["used"] + x["cost"] <= max_tokens)
        return F.when(fits, F.struct((s["used"] + x["cost"]).cast("long").alias("used"), F.concat(s["kept"], F.array(x["path"])).alias("kept"))).otherwise(s)

    out = ranked.groupBy("query").agg(paths.alias("paths"))
    return out.select("query", F.explode(F.aggregate("paths", state, step)["kept"]).alias("path"))


def coverage(kept: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, coverage): the share of a query's relevant paths that are kept."""
    hit = kept.select("query", "path", F.lit(1).alias("hit")).distinct()
    return relevant.distinct().join(hit, ["query", "path"], "left").groupBy("query").agg((F.count("hit") / F.count("*")).alias("coverage"))


def symbol_index(mentions: DataFrame) -> DataFrame:
    """(symbol, definitions, references) from (symbol, path, is_definition): sorted distinct paths."""
    paths = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("path"))))
    return mentions.groupBy("symbol").agg(paths(F.col("is_definition")).alias("definitions"), paths(~F.col("is_definition")).alias("references"))


def query_symbols(index: DataFrame) -> DataFrame:
    """Symbols worth asking for: defined in one path, not dunder, and referred to elsewhere."""
    return index.filter((F.size("definitions") == 1) & ~F.col("symbol").startswith("__") & (F.size(F.array_except("references", "definitions")) > 0)).select("symbol", F.element_at("definitions", 1).alias("path"))


def summary(trials: DataFrame, value: str) -> DataFrame:
    """(mean, median, stddev): the deviation of fewer than two values is 0."""
    return trials.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))


def bootstrap_median(values: list[float], resamples: int = 2000, seed: int = 1) -> tuple[float, float]:
    """The 95 % interval of the median."""
    rng, n = random.Random(seed), len(values)
    if not n:
        return 0.0, 0.0
    middle = lambda v: (v[(n - 1) // 2] + v[n // 2]) / 2
    medians = sorted(middle(sorted(rng.choices(values, k=n))) for _ in range(resamples))
    return medians[int(0.025 * resamples)], medians[int(0.975 * resamples) - 1]
