"""What the operators of this subpackage share: durable tables and prefix sums."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as the contracts count them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is named, a temporary one is set if all runs on this machine; a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        named = jsc.getCheckpointDir().get()
    return named.rstrip("/")


#: Bytes of a batch that goes to Python. Spark bounds its rows alone, and 10,000 long texts may be gigabytes.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose batches for Python are bounded in bytes; a bound that the session has already stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(2**31 - 1))) == 2**31 - 1:
        conf.set(name, str(BATCH_BYTES))
    return df


#: Paths of the tables that materialize() wrote and nothing has removed.
_written: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    bounded(df).write.parquet(path)
    _written.add(path)
    return stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df with the path of the table that it is read from."""
    df.table_path = path
    return df


def written() -> frozenset[str]:
    return frozenset(_written)


def release(spark: SparkSession, before: frozenset[str], *kept: DataFrame) -> None:
    """Removes the tables written since `before` but those kept, which nothing may read again, and lets go of the shuffle files of finished plans."""
    for path in _written - before - {k.table_path for k in kept}:
        _written.discard(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what a task makes of a row is held for few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def matrix(cells: pa.Array, kind: type) -> np.ndarray:
    """Binary cells of equal size as rows of numbers, not copied."""
    if not len(cells):
        return np.zeros((0, 0), kind)
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(cells), -1)


def views(cells: pa.Array, kind: type) -> list[np.ndarray]:
    """Each binary cell as numbers, not copied."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    return [data[a:b].view(kind) for a, b in zip(offsets, offsets[1:], strict=False)]


def source_key(source: Column) -> Column:
    """A non-null key that keeps a null source apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(key: Column, bits: int) -> Column:
    """The first bits of a signed 64-bit hash, in the order of the hash."""
    return F.shiftright(key, 64 - bits)


def bits_for(rows: int, per_bucket: int = 512) -> int:
    return max(1, min(40, (rows // per_bucket).bit_length()))


def bucket_offsets(sums: DataFrame, groups: list[str], bucket: str, total: str, out: str) -> DataFrame:
    """sums (one row for each group and bucket) with out, the sum of total over the group's lower buckets.

    Two levels: no window holds more than 1,024 buckets, or a 1,024th of a group's.
    """
    high = "__sl_high"
    sums = sums.withColumn(high, F.floor(F.col(bucket) / 1024))
    before = lambda w: F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inner = sums.withColumn(out, before(Window.partitionBy(*groups, high).orderBy(bucket)))
    tops = sums.groupBy(*groups, high).agg(F.sum(total).alias(total))
    tops = tops.select(*groups, high, before(Window.partitionBy(*groups).orderBy(high)).alias("__sl_base"))
    return inner.join(tops, [*groups, high]).withColumn(out, F.col(out) + F.col("__sl_base")).drop(high, "__sl_base")


def prefix_sums(df: DataFrame, groups: list[str], key: str, ties: list[str], value: str, out: str, bits: int) -> DataFrame:
    """df with out: the sum of value over the rows of the same group that come before in the order of key and ties.

    key is a 64-bit hash, so that a hot group spreads over 2**bits buckets; windows never hold a whole group.
    """
    b = "__sl_bucket"
    df = df.withColumn(b, bucket_of(F.col(key), bits))
    sums = df.groupBy(*groups, b).agg(F.sum(value).alias("__sl_sum"))
    offsets = bucket_offsets(sums, groups, b, "__sl_sum", "__sl_off").select(*groups, b, "__sl_off")
    w = Window.partitionBy(*groups, b).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
    return df.join(offsets, [*groups, b]).withColumn(out, F.col(out) + F.col("__sl_off")).drop(b, "__sl_off")
