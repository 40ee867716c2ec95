"""A corpus through five of the operators, each stage written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard, mixing, packing, quality, secret_scan
from spanloom.llm.common import materialize, release, written
from spanloom.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more): that of the smallest id, of several the one whose text has the smallest hash.

    SimHash proposes, and an exact join finds what its error budget leaves. Rows get numbers, as ids may be null or repeat.
    """
    rows = materialize(docs.withColumn("__sl_row", F.monotonically_increasing_id()), "pipeline-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    later = jaccard.later_copies(rows, "__sl_row", order=order)
    return rows.join(jaccard.few(later), "__sl_row", "left_anti").select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets cut out of their texts, n_chars along."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the last of an epoch, taken in part, counts whole; wordless ones stay once."""
    rows = materialize(docs.withColumn("__sl_row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = mixing.mix(rows, carry=("__sl_row",)).select("__sl_row", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("__sl_copies"))
    met = rows.join(taken.filter("__sl_copies > 0"), "__sl_row")
    return met.withColumn("__sl_copy", F.explode(F.sequence(F.lit(1), F.col("__sl_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", cut_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, decoding and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes once its result is written; the last stage's tables stay, as its rows are yet to be read."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
            release(spark, start, docs)
    return docs
