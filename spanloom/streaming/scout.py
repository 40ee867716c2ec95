"""The scout over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import MAX_FILE_BYTES
from ..operators import match
from ..plans.options import Options
from ..plans.patterns import compile_patterns


def watch(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, content) of the text files that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    files = files.filter((F.col("length") <= MAX_FILE_BYTES) & F.is_valid_utf8(F.col("content").cast("string")))
    return files.select("path", F.col("content").cast("string").alias("content"))


def scout_stream(files: DataFrame, patterns: list[str], options: Options = Options()) -> DataFrame:
    """(path, match_count, declaration_hint) of each file that matches: no state, so a stream of any length."""
    queries = compile_patterns(files.sparkSession, patterns, options)
    found = match.scout(match.with_lines(match.path_filters(files, options), options), queries, options.comments_only)
    return found.select("path", "match_count", "declaration_hint")
