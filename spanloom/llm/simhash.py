"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits are computed once for each document; all that follows works on distinct fingerprints. Two
that differ in few bits agree on two of five blocks of bits, whichever these are, so ten tables of such keys bring
them together. Within a bucket the trie of its fingerprints is joined with itself: pairs of nodes go down together,
differing bits add up, and a pair over the error budget is left. Buckets over BUCKET fingerprints are dealt anew by
two of five blocks of the bits that their key leaves open, twice if need be; then 14 bits are open, so no task gets an
unbounded bucket and no link is lost. Links are a spanning forest of each bucket; components come from alternating stars over tables.

Null texts count as empty and have fingerprint 0, linked like any other. Ties and repeated rows share fingerprints.
Rows with a null id take part; a component with no id at all has a null id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, stored, written

BITS, BLOCKS = 64, 5
#: Fingerprints that one trie may hold, and pairs of leaves below two nodes that are compared at once.
BUCKET, LEAF = 1024, 256


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Of the text's shingles in order, repeats included; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(depth: int) -> list[int]:
    """The 10**depth masks of the bits that must agree, after depth dealings."""
    out = [0]
    for _ in range(depth):
        longer = []
        for mask in out:
            free = [i for i in range(BITS) if not mask >> i & 1]
            cuts = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
            runs = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            longer += [mask | a | b for a, b in combinations(runs, 2)]
        out = longer
    return out


def trie_links(prints: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Indices of all pairs of the sorted distinct prints (uint64) that differ in budget bits at most."""
    n = len(prints)
    stack = [(0, n, 0, n, BITS - 1, 0)] if n > 1 else []
    while stack:
        a, b, c, d, bit, errors = stack.pop()
        if bit < 0 or (b - a) * (d - c) <= LEAF:
            near = np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= budget
            for i, k in zip(*np.nonzero(near), strict=True):
                if a + i < c + k:
                    yield a + int(i), c + int(k)
            continue
        mark = np.uint64(1 << bit)
        x = a + int(np.count_nonzero(~(prints[a:b] & mark).astype(bool)))
        y = x if a == c else c + int(np.count_nonzero(~(prints[c:d] & mark).astype(bool)))
        for p, q, r, s, more in ((a, x, c, y, 0), (x, b, y, d, 0), (a, x, y, d, 1), (x, b, c, y, 1)):
            if p < q and r < s and errors + more <= budget and not (a == c and p > r):
                stack.append((p, q, r, s, bit - 1, errors + more))


def forest(prints: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Those links that join two trees."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, k in trie_links(prints, budget):
        if (x := find(i)) != (y := find(k)):
            root[max(x, y)] = min(x, y)
            yield i, k


def _links(buckets: DataFrame, budget: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for cell in batch.column(0):
                prints = np.unique(np.array(cell.values, dtype=np.int64).view(np.uint64))
                for i, k in forest(prints, budget):
                    u.append(prints[i])
                    v.append(prints[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (u, v)], ["u", "v"])

    return buckets.select("prints").mapInArrow(run, "u long, v long")


def links(prints: DataFrame, budget: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) within budget bits, as far as any chain of such links does."""
    if budget > BLOCKS - 2:
        raise ValueError(f"at most {BLOCKS - 2} differing bits")
    out, todo, depth = None, prints.select("fp", F.lit(0).cast("long").alias("path")), 0
    while todo is not None:
        depth += 1
        table = F.array(*(F.lit(_signed(m)) for m in masks(depth)))
        keyed = todo.select("fp", F.explode(F.sequence(F.col("path") * 10, F.col("path") * 10 + 9)).alias("path"))
        keyed = keyed.select("fp", "path", F.col("fp").bitwiseAND(F.element_at(table, (F.col("path") + 1).cast("int"))).alias("key"))
        several = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = materialize(keyed.join(several, ["path", "key"]), f"simhash-keys-{depth}")
        # After three dealings 14 bits are open: such a bucket has 2**14 fingerprints at most.
        last = depth == 3
        small = met if last else met.filter(F.col("n") <= bucket)
        found = _links(small.groupBy("path", "key").agg(F.collect_list("fp").alias("prints")), budget)
        out = found if out is None else out.unionByName(found)
        hot = met.filter(F.col("n") > bucket)
        todo = None if last or hot.isEmpty() else hot.select("fp", "path")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest of its component, by alternating large and small stars.

    Each round is a table in the shared folder; joins are by key with nothing above them, so that hot nodes can be split.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
    last = None
    while True:
        before = written() - {edges.table_path}
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        edges = materialize(joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        release(spark, before, edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), edges.table_path)
        last = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id that links of budget differing bits at most reach."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    before = written()
    roots = components(links(nodes.select("fp"), budget))
    release(docs.sparkSession, before, roots)
    nodes = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "simhash-nodes")
    # A root is no node of its own star: it counts as alone, and its id as one of its component.
    alone = nodes.filter("not linked").select("root", "low")
    least = nodes.filter("linked").groupBy("root").agg(F.min("low").alias("least"))
    least = materialize(least.join(alone, "root").select("root", F.least("least", "low").alias("component_id")), "simhash-lows")
    final = materialize(nodes.join(least, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "simhash-components")
    return prints.join(final, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
