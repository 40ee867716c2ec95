"""Sharding over fixed virtual slots, by DataFrame operations only.

Records are hashed to SLOTS virtual slots, whose number never changes. Bytes are summed for each slot; a versioned map
gives every slot a shard. Rebalancing edits the map: it moves single slots from the fullest shard to the emptiest, so
that only their records move. The map is a table that is read back and edited the next time; a new version is added to
it, none is overwritten. It has SLOTS rows a version whatever the input, so it may be collected and broadcast.

Null texts have no bytes, and every record counts one more byte than its text. A null id hashes as an empty one. Rows of
equal id and text, however many, are dealt over the slots one after another, so that they fill all shards alike. An empty
table gives a map but no records. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .mixing import hash_key

SLOTS, SHARDS = 4096, 8


@dataclass(frozen=True)
class SlotMap:
    """Version by version, the shard of every slot."""

    versions: tuple[tuple[int, ...], ...]

    @property
    def current(self) -> tuple[int, ...]:
        return self.versions[-1]

    def rebalanced(self, load: list[int], shards: int = SHARDS) -> SlotMap:
        """With one more version: slots moved until no single move lessens the gap between the fullest and the emptiest shard."""
        at = list(self.current)
        total, held = [0] * shards, [[] for _ in range(shards)]
        for slot, shard in enumerate(at):
            total[shard] += load[slot]
            held[shard].append(slot)
        while True:
            full, bare = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
            gap = total[full] - total[bare]
            moves = [s for s in held[full] if 0 < load[s] < gap]
            if not moves:
                break
            slot = min(moves, key=lambda s: (abs(2 * load[s] - gap), s))
            held[full].remove(slot)
            held[bare].append(slot)
            total[full] -= load[slot]
            total[bare] += load[slot]
            at[slot] = bare
        return SlotMap((*self.versions, tuple(at)))

    def grown(self, load: list[int], shards: int) -> SlotMap:
        """With one more shard, which takes slots from the fullest shards until it has its share; no other slot moves."""
        at, total = list(self.current), [0] * (shards + 1)
        for slot, shard in enumerate(at):
            total[shard] += load[slot]
        for slot in sorted(range(len(at)), key=lambda s: (-load[s], s)):
            if load[slot] and total[shards] + load[slot] <= sum(total) / (shards + 1) and total[at[slot]] - load[slot] >= total[shards]:
                total[at[slot]] -= load[slot]
                total[shards] += load[slot]
                at[slot] = shards
        return SlotMap((*self.versions, tuple(at)))

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard) of all versions."""
        text = F.from_json(F.lit(json.dumps(self.versions)), "array<array<int>>")
        return spark.range(1).select(F.posexplode(text).alias("version", "shards")).select((F.col("version") + 1).alias("version"), F.posexplode("shards").alias("slot", "shard"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
    return SlotMap((tuple(s * shards // slots for s in range(slots)),))


def publish(plan: SlotMap, spark: SparkSession, path: str, after: int = 0) -> None:
    """Adds the versions beyond `after` to the map's table at a path; versions that are there already are left as they are."""
    plan.table(spark).filter(F.col("version") > after).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def stored_map(spark: SparkSession, path: str) -> SlotMap:
    """The map as its table has it, all versions."""
    rows = spark.read.parquet(path).select(F.col("version").cast("int"), "slot", "shard").collect()  # SLOTS rows a version
    held: dict[int, dict[int, int]] = {}
    for version, slot, shard in rows:
        held.setdefault(version, {})[slot] = shard
    return SlotMap(tuple(tuple(held[v][s] for s in range(len(held[v]))) for v in sorted(held)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, the number of each among those of equal id and text. Only such rows are shuffled, split by the task that wrote them."""
    same = ["key", "__sl_id", "size", "text_crc32"]
    many = rows.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if many.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    eq = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["__sl_id"].eqNullSafe(b["__sl_id"]) & (a["size"] == b["size"]) & (a["text_crc32"] == b["text_crc32"])
    many = materialize(many, "shard-repeated")
    alone = rows.join(many, eq(rows, many), "left_anti").withColumn("nth", F.lit(0).cast("long"))
    again = materialize(rows.join(many, eq(rows, many), "left_semi"), "shard-repeats")
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = again.groupBy(*same, "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = again.withColumn("own", F.row_number().over(Window.partitionBy(*same, "part").orderBy("text_crc32")) - 1)
    met = own.join(bases, eq(own, bases) & (own["part"] == bases["part"]))
    return alone.unionByName(met.select(*(own[c] for c in rows.columns), (F.col("base") + F.col("own")).alias("nth")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version): slot is the record's place in its shard.

    map_path: the table of a map to go on from; where there is none yet, or none is named, a first one is stored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.shiftright(hash_key(F.col(id_col), text), 3)
    rows = docs.select(F.col(id_col).alias("__sl_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), F.spark_partition_id().alias("part"))
    rows = materialize(rows, "shard-records")
    rows = _numbered(rows).withColumn("virtual_slot", F.pmod(F.col("key") + F.col("nth"), F.lit(SLOTS)).cast("int")).drop("part", "nth")
    load = materialize(rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records")), "shard-load")
    held = [0] * SLOTS
    for r in load.select("virtual_slot", "bytes").collect():  # SLOTS rows at most
        held[r[0]] = r[1]
    try:
        plan = stored_map(spark, map_path) if map_path else None
    except AnalysisException:  # nothing there yet
        plan = None
    map_path, known = map_path or f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}", len(plan.versions) if plan else 0
    next_plan = (plan or first_map(SLOTS, shards)).rebalanced(held, shards)
    if not plan or next_plan.current != plan.current:
        publish(next_plan, spark, map_path, known)
    now = spark.read.parquet(map_path).select(F.col("version").cast("int").alias("map_version"), F.col("slot").alias("virtual_slot"), "shard")
    now = now.filter(F.col("map_version") == len(stored_map(spark, map_path).versions))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = now.join(load.select("virtual_slot", "records"), "virtual_slot").withColumn("start", F.coalesce(F.sum("records").over(before), F.lit(0))).drop("records")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("key", "__sl_id", "size", "text_crc32")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(starts), "virtual_slot")
    return out.select(F.col("__sl_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
