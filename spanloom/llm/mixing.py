"""Mixing sources to target weights, by DataFrame operations only.

Sources in the order of their code points, null last, weigh WEIGHTS in turn and share all words by weight; no source
gets over LIMIT times its own words, and what such a one can't take goes to the others by weight. Within a source,
documents stand in the order of a hash; distributed prefix sums of their sizes cut the order at the source's budget:
whole epochs first, then the documents up to the exact word, of which the last may count in part.

A null text has no words. Rows with equal hash keys are ordered by id and size; equal rows are interchangeable. Rows
with a null id take part. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_for, materialize, prefix_sums, source_key, word_count

WEIGHTS, LIMIT = (5, 2, 1), 3


def hash_key(doc_id: Column, text: Column) -> Column:
    """A random 64-bit key that the row alone decides, the same in any engine that has MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") * 8


def source_targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, target): one row for each source. The windows here hold one row for each source, no documents."""
    sums = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = sums.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * LIMIT).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # Sources fill up in the order of ratio; the first that its level doesn't fill sets the level of all that follow.
    table = table.withColumn("level", level)
    final = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(all_rows)
    return table.withColumn("final", final).select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken), and the columns named in carry, which must not clash with these."""
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).alias("__sl_id"), *carry, F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("skey"), word_count(text).alias("size"), hash_key(F.col(id_col), text).alias("key"))
    sized = materialize(sized, "mixing-sizes")
    targets = source_targets(sized)
    placed = prefix_sums(sized, ["skey"], "key", ["__sl_id", "size"], "size", "before", bits_for(sized.count()))
    size, whole = F.col("source_size"), F.round("target").cast("long")
    placed = placed.join(targets, "skey").withColumn("budget", F.least(whole, size * LIMIT))
    epochs = F.when(size > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("budget") - epochs * size
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(F.col("__sl_id").alias(id_col), *carry, "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))
