"""Groups of near copies: SimHash fingerprints, and the exact Jaccard similarity of word shingles.

Two texts of similarity NUMERATOR / DENOMINATOR differ in more bits of a 64-bit fingerprint than a trie join can allow
for. So SimHash serves twice. First the trie join of op5 links what differs in few bits; it brings most copies together
cheaply. Then candidates come from prefixes: of every set of shingles the PREFIX in one order of all shingles is kept;
similar sets overlap so much that their prefixes share a shingle, whatever the order is. Of the pairs in such a bucket
those are left out whose fingerprints of WIDE bits differ in more than BUDGET of them. Of similar sets a bit differs with
odds of a fifth at most, so that this loses a similar pair with odds under 1e-11. Every pair that is linked, whatever
proposed it, is held against both whole sets.

Texts whose sets are equal are one node, so exact copies cost no pairs. In rounds, every node is held against the one
node of another group with which it shares most buckets, and groups that meet become one; then follow all rows that
still have such a partner of another group in a bucket, pair by pair within the task of the bucket. Common shingles, as a sample tells them, come last in the order, so
buckets stay small; the sample decides on speed only. Large buckets are dealt into blocks, and pairs of blocks go to
tasks of their own, so no task holds an unbounded bucket.

Shingles are compared by 64-bit hashes. Texts of fewer words than a shingle are one shingle; null, empty and blank texts
have none and are copies of each other. Row numbers must be unique and not negative; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, views, written
from .simhash import components, links, majority, shingle_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Members of a bucket that one task pairs, and rounds before the pairs that remain are sought.
BLOCK, ROUNDS = 256, 2
#: Bits of the fingerprints that rule pairs out, and how many of them may differ.
WIDE, BUDGET = 256, 96
#: One document in so many is sampled for common shingles; so many are remembered, each met so often in the sample.
SAMPLE, COMMON, OFTEN = 16, 1 << 16, 3


SKETCH = [f"w{k}" for k in range(WIDE // 64)]
#: The least tokens of a node that are in buckets; the greatest integer where there are fewer.
LOW = [f"low{k}" for k in range(8)]
#: Ids that may be broadcast.
FEW = 200_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, distinct and sorted."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which one at least is in every similar set's prefix: the first in the order of rarity, then of the hash."""
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, rank[at], 0), kind="stable")]
    return own[: len(own) + 1 - -(-NUMERATOR * len(own) // DENOMINATOR)] if len(own) else own


def wide_print(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set in WIDE bits, as 64-bit integers: majorities of the bits of hashes mixed anew for each of these."""
    ones = [np.zeros(64, np.int64) for _ in SKETCH]
    for at in range(0, len(own), 1 << 14):
        part = own[at : at + (1 << 14)].view(np.uint64)
        for k, count in enumerate(ones, 1):
            z = part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            count += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.array([np.packbits(2 * c > len(own), bitorder="little").view(np.int64)[0] for c in ones])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles that a sample has often, how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            s, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], ["s", "n"])

    counts = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = counts.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(COMMON).toArrow()  # COMMON rows at most
    s, n = got.column("s").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _marks(docs: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(id, node, n, fp, the words of the wide fingerprint, prefix): node is the hash of the whole set, fp op5's fingerprint over these shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(t, SHINGLE) for t in batch.column(1).to_pylist()]
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            nodes, prints = (np.array(x, np.uint64).view(np.int64) for x in ([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], [majority(h) for h in hashes]))
            wide = np.array([wide_print(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
            firsts = pa.array([prefix(s, common, rank) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), *(pa.array(wide[:, k].copy()) for k in range(len(SKETCH))), firsts], ["id", "node", "n", "fp", *SKETCH, "prefix"])

    words = ", ".join(f"{w} long" for w in SKETCH)
    return docs.mapInArrow(run, f"id long, node long, n int, fp long, {words}, prefix array<long>")


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, s): the whole sets of the nodes asked for, made anew from their texts; only these travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "s"])

    asked = materialize(nodes.select("id", "node").join(few(asked), "node", "left_semi"), "jaccard-asked")
    return materialize(docs.select("id", "text").join(few(asked), "id").select("node", "text").mapInArrow(run, "node long, s binary"), "jaccard-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs whose whole sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = (views(batch.column(c), np.int64) for c in ("a", "b"))
            yield batch.select(["u", "v"]).filter(pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    whole = _sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs)
    met = pairs.join(whole.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(whole.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return met.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _simhash_pairs(reps: DataFrame) -> DataFrame:
    """(u, v): nodes that SimHash links, as a forest over the fingerprints and a star over the nodes of each; without those whose sizes or wide fingerprints rule it out."""
    first = reps.groupBy("fp").agg(F.min("node").alias("first"))
    stars = reps.join(first, "fp").filter(F.col("node") > F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = links(first.select("fp"))
    u, v = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "uv")
    pairs = stars.unionByName(near.join(u, "u").join(v, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))
    a, b = (reps.select(F.struct("node", "n", *SKETCH).alias(c)) for c in "ab")
    met = pairs.join(a, F.col("u") == F.col("a.node")).join(b, F.col("v") == F.col("b.node"))
    return met.filter(_near(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))).select("u", "v")


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """As far as sizes and fingerprints tell."""
    far = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in SKETCH), F.lit(0))
    least, most = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
    return (far <= BUDGET) & (DENOMINATOR * least >= NUMERATOR * most)


def _best_pairs(members: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v): each node with the one of another group that it shares most buckets with, of those not tried."""
    at = F.struct("root", "node", "n", *SKETCH)
    ends = members.groupBy("token").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo.root < hi.root")
    other = F.when(F.col("root") != F.col("lo.root"), F.col("lo")).otherwise(F.col("hi"))
    met = members.join(ends, "token").withColumn("other", other).filter(_near(F.col, lambda c: F.col(f"other.{c}")))
    votes = met.groupBy(F.least("node", "other.node").alias("u"), F.greatest("node", "other.node").alias("v"), "node").agg(F.count("*").alias("votes"))
    votes = votes.join(tried, ["u", "v"], "left_anti")
    return votes.groupBy("node").agg(F.max_by(F.struct("u", "v"), F.struct("votes", "u", "v")).alias("e")).select("e.u", "e.v").distinct()


def bucket_pairs(token: int, root: np.ndarray, n: np.ndarray, wide: np.ndarray, low: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): a bucket's pairs of different groups that sizes and fingerprints don't rule out, by positions.

    low: some of the least tokens of each row; a pair that shares one below this bucket's is left to the bucket of that.
    side: 0 or 1 for pairs between two blocks, all 0 for pairs within one.
    """
    names, counts = np.unique(root, return_counts=True)
    two, every = side.any(), np.arange(len(root))
    # Rows to pair: those of one block, or all but the largest group.
    rows = np.flatnonzero(side == 0) if two else np.flatnonzero(root != names[counts.argmax()])
    inside = np.zeros(len(root), bool)
    inside[rows] = True
    for i in rows:
        k = np.flatnonzero((root != root[i]) & ((side == 1) if two else ~inside | (every > i)) & (np.minimum(n[i], n) * DENOMINATOR >= NUMERATOR * np.maximum(n[i], n)))
        k = k[np.bitwise_count((wide[k] ^ wide[i]).view(np.uint64)).sum(axis=1) <= BUDGET]  # of signed ones it would count the absolute value
        if len(before := low[i][low[i] < token]):
            k = k[~np.isin(low[k], before).any(axis=1)]
        if len(k):
            yield int(i), k


def similar_links(pairs: Iterator[tuple[int, np.ndarray]], root: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Those pairs whose whole sets are similar, as far as they join groups that nothing has joined before."""
    names, at = np.unique(root, return_inverse=True)
    group = np.arange(len(names))
    for i, k in pairs:
        own = sets[i]
        k = k[group[at[k]] != group[at[i]]]
        if not len(k):
            continue
        sizes = np.array([len(sets[x]) for x in k])
        flat = np.concatenate([sets[x] for x in k])
        met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(met.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        for x in k[both * DENOMINATOR >= NUMERATOR * (len(own) + sizes - both)]:
            if group[at[x]] != group[at[i]]:
                group[group == group[at[x]]] = group[at[i]]
                yield i, int(x)


MEMBER = ["node", "root", "n", "part", *SKETCH, *LOW]


def _bucket(rows: pa.StructArray, token: int, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
    """bucket_pairs of the rows of a block, or of two, of a bucket."""
    of = lambda c: rows.field(c).to_numpy()
    wide, low = (np.stack([of(c) for c in cols], axis=1) for cols in (SKETCH, LOW))
    return bucket_pairs(token, of("root"), of("n").astype(np.int64), wide, low, ((of("part") == b) & (a != b)).astype(int))


def _other_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """(u, v): links between different groups within all buckets.

    First each bucket tells which of its rows have a partner that sizes and fingerprints allow; then these rows alone meet
    again with their sets. Either time a bucket gives rows, never pairs, so a dense bucket costs no more than its size.
    """
    keys = ["token", "a", "b"]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for token, a, b, cell in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                rows = cell.values
                if met := [x for i, k in _bucket(rows, token, a, b) for x in (np.array([i]), k)]:
                    kept = rows.take(pa.array(np.unique(np.concatenate(met))))
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(kept), pa.int64()) for x in (token, a, b)), *(kept.field(c) for c in MEMBER)], [*keys, *MEMBER])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            u, v = [], []
            for token, a, b, cell in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                rows = cell.values
                node = rows.field("node").to_numpy()
                for i, k in similar_links(_bucket(rows, token, a, b), rows.field("root").to_numpy(), views(rows.field("s"), np.int64)):
                    u.append(node[i])
                    v.append(node[k])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    sizes = members.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    live = members.join(sizes.select("token", F.ceil(F.col("size") / block).cast("long").alias("parts")), "token")
    live = live.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    live = live.join(nodes.select("node", *LOW), "node").select("token", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), *MEMBER)
    rows = live.groupBy(*keys).agg(F.collect_list(F.struct(*MEMBER)).alias("rows"))
    words = ", ".join(f"{c} long" for c in (*SKETCH, *LOW))
    left = materialize(rows.mapInArrow(partnered, f"token long, a long, b long, node long, root long, n int, part long, {words}"), "jaccard-left")
    whole = _sets(left.select("node").distinct(), nodes, docs)
    again = left.join(whole, "node").groupBy(*keys).agg(F.collect_list(F.struct(*MEMBER, "s")).alias("rows"))
    return again.mapInArrow(linked, "u long, v long").distinct()


def later_copies(docs: DataFrame, row_col: str, text_col: str = "text", order: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(row): of each group that chains of similar texts connect, all rows but the one that is first by order, then by number."""
    spark, start = docs.sparkSession, written()
    order = F.lit(0) if order is None else order
    docs = docs.select(F.col(row_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), order.alias("order"))
    common, rank = _common(docs)
    marks = materialize(_marks(docs.select("id", "text"), common, rank), "jaccard-marks")
    first = marks.groupBy("node").agg(F.min("id").alias("id"))
    reps = marks.join(first, ["node", "id"], "left_semi")
    tokens = reps.select("node", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token")
    met = materialize(tokens.join(shared, "token"), "jaccard-buckets")
    release(spark, start, marks, met)
    # A pair that shares no shingle of its prefixes can't be similar, so other nodes take no part.
    slim = marks.drop("prefix").join(first, ["node", "id"], "left_semi")
    least = met.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    least = least.select("node", *(F.coalesce(F.get("tokens", F.lit(k)), F.lit(2**63 - 1)).alias(c) for k, c in enumerate(LOW)))
    nodes = materialize(slim.join(least, "node"), "jaccard-nodes")
    members = materialize(met.join(nodes.drop("id", "fp", *LOW), "node"), "jaccard-members")
    base = (marks, members, nodes)
    release(spark, start, *base)
    tried = materialize(_simhash_pairs(nodes), "jaccard-simhash")
    release(spark, start, *base, tried)
    found = None
    for turn in range(ROUNDS + 2):
        if turn:
            rooted = materialize(_rooted(members, found), "jaccard-rooted")
        if turn > ROUNDS:
            more = _other_links(rooted, nodes, docs, block)
        else:
            held = materialize(_best_pairs(rooted, tried), "jaccard-pairs") if turn else tried
            tried = materialize(tried.unionByName(held), "jaccard-tried") if turn else tried
            more = _verified(held, nodes, docs)
        edges = more if found is None else more.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
        found = components(edges)
        release(spark, start, *base, tried, found)
    rows = materialize(marks.select("id", "node").join(docs.select("id", "order"), "id"), "jaccard-rows")
    best = rows.groupBy("node").agg(F.min(F.struct("order", "id")).alias("best"))
    groups = best.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    out = materialize(rows.select("id").join(groups.select(F.col("best.id").alias("id")), "id", "left_anti").withColumnRenamed("id", row_col), "jaccard-later")
    release(spark, start, out)
    return out
