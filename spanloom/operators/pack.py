"""Fitting spans into a token budget."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.durable import cut
from .rank import placed

#: Spans that one task folds at once; of more, the driver sees so many at a time.
AT_ONCE = 1 << 16


def budget_gate(spans: DataFrame, n_queries: int, max_tokens: int) -> DataFrame:
    """Spans of the batches of files up to the first after which every query has its share of tokens.

    Needs candidate_rank (from 1), query_index and tokens. The grid has a row for each batch and query.
    """
    share = max(1, T.OVERSAMPLE * max_tokens // n_queries)
    spans = spans.withColumn("batch", F.floor((F.col("candidate_rank") - 1) / T.BATCH))
    grid = spans.select("batch").distinct().withColumn("query_index", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    spent = spans.groupBy("batch", "query_index").agg(F.sum("tokens").alias("spent"))
    w = Window.partitionBy("query_index").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce("spent", F.lit(0))).over(w)
    full = grid.join(spent, ["batch", "query_index"], "left").withColumn("total", total).groupBy("batch").agg(F.min("total").alias("least")).filter(F.col("least") >= share)
    stop = full.agg(F.min("batch").alias("stop"))
    return spans.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("batch") <= F.col("stop"))).drop("batch", "stop")


def fill(rows: list[tuple[str, int, bool]], max_tokens: int, cap: int, barred: frozenset[int] = frozenset()) -> list[int]:
    """Positions of (path, tokens, is_declaration) taken in order: what doesn't fit is passed over, and counts for no cap."""
    used, taken, out = 0, Counter(), []
    for i, (path, tokens, _) in enumerate(rows):
        if i in barred or cap and taken[path] >= cap or used + tokens > max_tokens:
            continue
        out.append(i)
        taken[path] += 1
        used += tokens
        if used >= max_tokens:
            break
    return out


#: A row taken: (place, path, tokens, is_declaration).
Taken = tuple[int, str, int, bool]


def fill_from(fetch: Callable[[int, int], list[Taken]], max_tokens: int, cap: int, barred: frozenset[int] = frozenset(), taken: list[Taken] | None = None, after: int = 0) -> list[Taken]:
    """As fill, the rows taken, for lists of any length; it goes on after a place, with what is taken up to there.

    fetch(after, most): the next AT_ONCE rows beyond a place that cost most tokens or less; others would be passed over.
    """
    out = list(taken or [])
    used, counts = sum(t[2] for t in out), Counter(t[1] for t in out)
    while not out or used < max_tokens:
        rows = fetch(after, max_tokens - used)
        for row in rows:
            place, path, tokens, _ = row
            if place in barred or cap and counts[path] >= cap or used + tokens > max_tokens:
                continue
            out.append(row)
            counts[path] += 1
            used += tokens
            if used >= max_tokens:
                return out
        if len(rows) < AT_ONCE:
            break
        after = rows[-1][0]
    return out


def with_floor(refill: Callable[[frozenset[int], list[Taken], int], list[Taken]], floor: int) -> list[int]:
    """The last declarations taken give way until floor other spans fit; if that can't be, the plain fill.

    What was taken before a declaration that gives way stays, so each refill goes on from there.
    """
    plain = taken = refill(frozenset(), [], 0)
    barred: frozenset[int] = frozenset()
    while sum(not declares for *_, declares in taken) < floor:
        last = next((t[0] for t in reversed(taken) if t[3]), None)
        if last is None:
            taken = plain
            break
        barred |= {last}
        taken = refill(barred, [t for t in taken if t[0] < last], last)
    return [t[0] for t in taken]


def fill_with_references(rows: list[tuple[str, int, bool]], max_tokens: int, cap: int, floor: int) -> list[int]:
    """Positions of (path, tokens, is_declaration) taken."""
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]

    def fetch(after: int, most: int) -> list[Taken]:
        return list(itertools.islice((r for r in itertools.islice(numbered, after, None) if r[2] <= most), AT_ONCE))

    return [i - 1 for i in with_floor(lambda barred, taken, after: fill_from(fetch, max_tokens, cap, barred, taken, after), floor)]


def pack(spans: DataFrame, max_tokens: int, cap: int, min_references: int, order: list, few: bool | None = None) -> DataFrame:
    """The spans that fit, in a total order. The gate keeps them few, but where a pattern never gets its share they may be all.

    few: whether AT_ONCE holds them, where that is known.
    """
    if not (spans.count() <= AT_ONCE if few is None else few):
        return pack_many(spans, max_tokens, cap, min_references, order)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    ranked = spans.withColumn("place", F.row_number().over(w))
    narrow = ranked.select("place", "path", "tokens", "is_declaration")

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rows = list(group[["path", "tokens", "is_declaration"]].itertuples(index=False, name=None))
        return group.iloc[fill_with_references(rows, max_tokens, cap, min_references)][["place"]]

    kept = narrow.groupBy(F.lit(0).alias("one")).applyInPandas(lambda g: chosen(g), "place int")
    return ranked.join(kept, "place", "left_semi")


def pack_many(spans: DataFrame, max_tokens: int, cap: int, min_references: int, order: list) -> DataFrame:
    """As pack, with the fold on the driver over bounded pages of the ranked spans."""
    ranked = cut(placed(spans, [], order, "place"))

    def fetch(after: int, most: int) -> list:
        page = ranked.filter((F.col("place") > after) & (F.col("tokens") <= most)).orderBy("place").limit(AT_ONCE)
        return [tuple(r) for r in page.select("place", "path", "tokens", "is_declaration").collect()]

    kept = with_floor(lambda barred, taken, after: fill_from(fetch, max_tokens, cap, barred, taken, after), min_references)
    return ranked.join(spans.sparkSession.createDataFrame([(p,) for p in kept], "place long"), "place", "left_semi")


def capped(spans: DataFrame, cap: int, order: list) -> DataFrame:
    """Without a budget, the first spans of each file."""
    if not cap:
        return spans
    return spans.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter(F.col("nth") <= cap).drop("nth")
