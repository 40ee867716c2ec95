"""Exact top-k inner products over a pivot-distance index.

Vectors become points of one more dimension, sqrt(M^2 - |v|^2) with M the largest norm, and queries points with 0
there; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the largest inner products are the nearest points. Every vector is
keyed by its nearest pivot and its distance to it; a pivot's vectors are cut into annuli by distance, and annuli into
blocks of about BLOCK rows sorted by distance. There are more pivots as there are more vectors, PIVOTS to MOST_PIVOTS.

A query goes out twice. First to one block of the annulus that may hold its nearest points; what it finds there, and in a
bounded sample, bounds its k-th score from below. Then to the annuli that the triangle inequality leaves within that
bound, and within a block to the rows within its radius, which shrinks as better scores are found. Either time blocks and
the queries that ask for them are sorted together, so a block is sent once however many queries come. All scores are
exact integers.

Pivots, ring edges and the first bounds come from a sample of vectors, chosen by the hash of their id; every vector is
indexed and any sample gives the same result. Vectors null, or holding null or non-finite components, take no part,
nor do rows with a null id. Shorter vectors count as padded with zeros. A query's own id is no candidate, repeated or
not. With no vectors or no queries the result is empty. Components beyond 64-bit integers count as the largest of these,
and so do scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, matrix

PIVOTS, MOST_PIVOTS, RINGS, SAMPLE, BLOCK, QUERIES = 16, 256, 8, 2048, 4096, 512
#: Slack for rounded distances; scores themselves are exact.
EPS = 1e-6


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of valid vectors."""
    x = F.col(vector_col)
    valid = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(valid).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def _matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, padded."""
    sizes = np.diff(cells.offsets.to_numpy())
    flat = cells.values.to_numpy(zero_copy_only=False)[cells.offsets[0].as_py() : cells.offsets[-1].as_py()]
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.arange(0)])] = flat
    return out


def _lifted(m: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(0, most - (m * m).sum(1)))[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None]) ** 2).sum(2)) if len(points) * pivots.size < 1 << 24 else np.vstack([_distances(p, pivots) for p in np.array_split(points, 2)])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: by floating point where no sum can leave its integers."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    rows = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in r] for r in rows], np.int64)


def fit_pivots(sample: np.ndarray, most: float, count: int = PIVOTS) -> np.ndarray:
    points = np.unique(_lifted(sample, most), axis=0)
    rng = np.random.default_rng(7)
    pivots = points[rng.choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(4):
        near = _distances(points, pivots).argmin(1)
        pivots = np.array([points[near == k].mean(0) if (near == k).any() else p for k, p in enumerate(pivots)])
    return pivots


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def _search(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, dq: np.ndarray, dist: np.ndarray, vid: np.ndarray, v: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of each query's k best in a block that reach its floor."""
    square = (q * q).sum(1) + most
    # Chunks of the block, nearest to the queries' own distances first; each raises the floors for those that follow.
    floor, found, step = floor.copy(), [], 512
    for a in sorted(range(0, len(dist), step), key=lambda a: abs(np.median(dq) - dist[min(a + step // 2, len(dist) - 1)])):
        reach = np.sqrt(np.maximum(0, square - 2 * floor)) * (1 + EPS) + EPS
        who = np.flatnonzero(np.maximum(dist[a] - dq, dq - dist[min(a + step, len(dist)) - 1]) <= reach)
        if not len(who):
            continue
        s = _scores(q[who], v[a : a + step].astype(np.float64))
        x, y = np.nonzero((s >= floor[who][:, None]) & (vid[a : a + step][None] != ids[who][:, None]))
        if not len(x):
            continue
        best = _best(x, vid[a + y], s[x, y], k)
        found.append((who[x[best]], vid[a + y[best]], s[x[best], y[best]]))
        full = np.bincount(x[best], minlength=len(who)) >= k
        worst = np.full(len(who), np.iinfo(np.int64).max)
        np.minimum.at(worst, x[best], s[x[best], y[best]])
        floor[who[full]] = np.maximum(floor[who[full]], worst[full])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    x, y, s = (np.concatenate(z) for z in zip(*found, strict=True))
    best = _best(x, y, s, k)
    return ids[x[best]], y[best], s[best]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among all other rows. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    rows = materialize(rows, "topk-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dim, most, total = rows.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim:
        return empty
    n_pivots = min(MOST_PIVOTS, max(PIVOTS, total // (RINGS * BLOCK)))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 16 * n_pivots) if n_pivots > PIVOTS else SAMPLE).select("vec_id", "v").toArrow()
    s_ids, s_vec = some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks(), dim)
    pivots = fit_pivots(s_vec, most, n_pivots)
    near = (d := _distances(_lifted(s_vec, most), pivots)).argmin(1)
    edges = [np.unique(np.quantile(d[near == p, p], np.linspace(0, 1, RINGS + 1)[1:-1])) if (near == p).any() else np.zeros(0) for p in range(len(pivots))]
    # No component is larger than the largest norm.
    kind = "<i2" if np.sqrt(most) < 32767 else "<f8"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim)
            d = _distances(_lifted(m, most), pivots)
            p = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            near = d[np.arange(len(d)), p]
            ring = np.array([np.searchsorted(edges[i], x, "right") for i, x in zip(p, near, strict=True)], np.int64)
            cells = [x.tobytes() for x in m.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), pa.array(p * RINGS + ring, pa.int64()), pa.array(near)], ["vec_id", "v", "cell", "dist"])

    index = materialize(rows.select("vec_id", "v").mapInArrow(keyed, "vec_id long, v binary, cell long, dist double"), "topk-index")
    # One row for each annulus: MOST_PIVOTS * RINGS at most.
    ring = {r["cell"]: (r["lo"], r["hi"], -(-r["n"] // BLOCK)) for r in index.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).collect()}
    cells = np.array(sorted(ring))
    lo, hi, n_salts = (np.array([ring[c][i] for c in sorted(ring)]) for i in range(3))
    salts = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cells, n_salts, strict=True)], "cell long, salts long")
    dealt = index.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    blocks = dealt.groupBy("cell", "salt").agg(F.sort_array(F.collect_list(F.struct("dist", "vec_id", "v"))).alias("rows"))
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "q", "floor", "dq")]
    blocks = materialize(blocks.select("cell", "salt", F.lit(0).alias("kind"), *nothing, "rows"), "topk-blocks")
    no_rows = F.lit(None).cast(blocks.schema["rows"].dataType).alias("rows")

    def sent(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each chunk of queries, a row for each block that some of them go to."""
            for b in batches:
                for start in range(0, b.num_rows, QUERIES):
                    part = b.slice(start, QUERIES)
                    ids, q = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                    s = _scores(q, s_vec).astype(np.float64)
                    s[ids[:, None] == s_ids[None]] = -np.inf
                    floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
                    d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, cells // RINGS]
                    apart = np.maximum(0, np.maximum(lo - d, d - hi))
                    home = np.lexsort((d, apart), axis=1)[:, 0] if len(cells) else np.zeros(len(q), int)
                    salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_salts[home]
                    if not first:
                        found = part.column(2).to_numpy(zero_copy_only=False)
                        floor = np.where(np.isnan(found), floor, np.fmax(floor, found))
                        reach = np.sqrt(np.maximum(0, (q * q).sum(1) + most - 2 * floor)) * (1 + EPS) + EPS
                    for j, c in enumerate(cells):
                        for x in range(int(n_salts[j])):
                            here = (home == j) & (salt == x)
                            goes = here if first else (apart[:, j] <= reach) & ~here
                            if goes.any():
                                small = q[goes].astype("<i2") if np.abs(q[goes]).max(initial=0) < 32768 else q[goes]
                                width = pa.array([small.dtype.itemsize], pa.int32())
                                yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([x]), width, *(pa.array([y.tobytes()]) for y in (ids[goes], small, floor[goes], d[goes, j]))], ["cell", "salt", "kind", "ids", "q", "floor", "dq"])

        return run

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, the block itself first: it is held while the queries that ask for it pass."""
        block = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if batch.column(2)[i].as_py() == 0:
                    held = batch.column(7)[i].values
                    block = held.field("dist").to_numpy().copy(), held.field("vec_id").to_numpy().copy(), matrix(held.field("v"), kind).copy()
                    continue
                of = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)  # noqa: B023, E731
                ids = of(3, np.int64)
                q = of(4, "<i2" if batch.column(2)[i].as_py() == 2 else np.float64).reshape(len(ids), dim).astype(np.float64)
                out.append(_search(ids, q, of(5, np.float64), of(6, np.float64), *block, most, k))
            cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def asked(queries: DataFrame, first: bool) -> DataFrame:
        routes = queries.mapInArrow(sent(first), "cell long, salt long, kind int, ids binary, q binary, floor binary, dq binary").withColumn("rows", no_rows)
        met = blocks.unionByName(routes).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        return met.mapInArrow(searched, "query_id long, vec_id long, score long")

    # Equal rows are one query; what different vectors of one id find is ranked together.
    queries = rows.filter("is_query").select("vec_id", "v").dropDuplicates()
    near_by = materialize(asked(queries, True), "topk-first")
    bound = near_by.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") == k)
    bound = bound.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    rest = asked(queries.join(bound, "vec_id", "left").select("vec_id", "v", "bound"), False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = near_by.unionByName(rest)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, queries: list[int], k: int = 5) -> pd.DataFrame:
    """What top_k has to return, by all scores of each query."""
    out = []
    for i in queries:
        s = sorted((-int(vectors[i] @ vectors[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out += [(ids[i], r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
