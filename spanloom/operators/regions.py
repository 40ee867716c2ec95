"""From matches to regions of text: enclosing declarations, windows, collapse and merge. A file is a row, and all of its matches stay in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.options import Options
from ..plans.patterns import Query
from .match import computed


def enclosing(decls: Column, line: Column) -> Column:
    """The last declaration that starts at or before a line, if it reaches it: an as-of lookup in the file's own table."""
    last = F.try_element_at(F.filter(decls, lambda d: d["start_line"] <= line), F.lit(-1))
    return F.when(last["end_line"] >= line, last)


def asof_join(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, line_no) with the declaration that encloses it, as a join of tables: one sorted pass by path, no pairs."""
    facts = F.struct("name", "kind", "start_line", "end_line", "depth")
    both = lines.select("path", F.col("line_no").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<name:string,kind:string,start_line:bigint,end_line:bigint,depth:int>").alias("d"))
    both = both.unionByName(decls.select("path", F.col("start_line").alias("at"), F.lit(0).alias("side"), facts.alias("d")))
    w = Window.partitionBy("path").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("d", F.last("d", ignorenulls=True).over(w)).filter("side = 1")
    d = F.when(F.col("d.end_line") >= F.col("at"), F.col("d"))
    return met.select("path", F.col("at").alias("line_no"), d.alias("d")).select("path", "line_no", "d.*")


def windows(files: DataFrame, queries: list[Query], options: Options) -> DataFrame:
    """files with windows: for each match (line, q, start, end, symbol, kind, depth, declares). All within the file's own row."""
    total, c = F.size("lines").cast("long"), F.lit(options.orphan_context)

    def one(m: Column) -> Column:
        line = m["line"]
        d = enclosing(F.col("decls"), line)
        small = d["end_line"] - d["start_line"] < options.whole_lines
        named = d.isNotNull() & (small | (line == d["start_line"]))
        low, high = line - c, F.least(line + c, total)
        start = F.when(d.isNull(), F.greatest(F.lit(1).cast("long"), low)).when(small, d["start_line"]).otherwise(F.greatest(low, d["start_line"]))
        end = F.when(d.isNull(), high).when(small, F.least(d["end_line"], total)).otherwise(F.least(high, d["end_line"]))
        symbol, kind = F.when(named, d["name"]), F.when(named, d["kind"])
        hit = F.coalesce(*(F.when(m["q"] == q.index, symbol.rlike(q.regex)) for q in queries), F.lit(False))
        declares = (start == line) & F.coalesce(kind != "impl", F.lit(False)) & hit
        return F.struct(start.alias("start"), end.alias("end"), line.alias("line"), m["q"].alias("q"), symbol.alias("symbol"), kind.alias("kind"), F.when(named, d["depth"]).otherwise(0).alias("depth"), declares.alias("declares"))

    return files.withColumn("windows", computed(F.array_sort(F.transform(F.array_distinct("matches"), one))))


def _parts(found: Column, n_queries: int) -> dict[str, Column]:
    """What several windows say together."""
    of = lambda i: F.size(F.filter(found, lambda w: w["q"] == i))
    per = [of(i) for i in range(n_queries)]
    return {"match_lines": F.array_sort(F.array_distinct(F.transform(found, lambda w: w["line"]))), "per_query": F.array(*per), "declaring": F.array_min(F.transform(F.filter(found, lambda w: w["declares"]), lambda w: w["q"]))}


def _lead(found: Column) -> Column:
    """Symbol, kind and depth of the first window that has a symbol, and of those on the same lines."""
    named = F.filter(found, lambda w: w["symbol"].isNotNull())
    first = F.element_at(named, 1)
    same = F.filter(named, lambda w: (w["start"] == first["start"]) & (w["end"] == first["end"]))
    of = lambda pick, name: pick(F.transform(same, lambda w: w[name]))
    return F.when(F.size(named) > 0, F.struct(of(F.array_min, "symbol").alias("symbol"), of(F.array_min, "kind").alias("kind"), of(F.array_max, "depth").alias("depth")))


def _runs(windows: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """The array cut where breaks(the furthest end so far, window) holds, as an array of arrays.

    One pass finds the places of the cuts; no text is moved.
    """
    state = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, w: Column) -> Column:
        cuts = F.when(breaks(s, w), F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"])
        return F.struct(F.greatest(s["end"], w["end"]).alias("end"), (s["at"] + 1).alias("at"), cuts.alias("cuts"))

    cuts = F.aggregate(windows, state, step)["cuts"]
    return F.transform(F.arrays_zip(cuts.alias("a"), F.concat(F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))), F.array(F.size(windows))).alias("b")), lambda c: F.slice(windows, c["a"] + 1, c["b"] - c["a"]))


def collapse(files: DataFrame, n_queries: int) -> DataFrame:
    """files with parts: matches with the same window as one, with matched lines, counts by query, and the first query it declares. Needs windows."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["symbol"].isNull() == b["symbol"].isNull())
    keys = F.array_distinct(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.when(w["symbol"].isNotNull(), "x").alias("symbol"))))

    def one(k: Column) -> Column:
        own = F.filter("windows", lambda w: same(w, k))
        return F.struct(k["start"].alias("start"), k["end"].alias("end"), k["symbol"].isNotNull().alias("has_symbol"), *(v.alias(n) for n, v in _parts(own, n_queries).items()))

    return files.withColumn("parts", computed(F.transform(keys, one)))


def merge(files: DataFrame, n_queries: int) -> DataFrame:
    """files with regions: windows that overlap as one; those that only touch stay apart. Needs windows, sorted by start and end."""

    def one(run: Column) -> Column:
        lead = _lead(run)
        end = F.array_max(F.transform(run, lambda w: w["end"]))
        return F.struct(F.element_at(run, 1)["start"].alias("start"), end.alias("end"), lead["symbol"].alias("symbol"), lead["kind"].alias("kind"), F.coalesce(lead["depth"], F.lit(0)).alias("depth"), *(v.alias(n) for n, v in _parts(run, n_queries).items()))

    return files.withColumn("regions", computed(F.transform(_runs(F.col("windows"), lambda s, w: w["start"] > s["end"]), one)))


def owned(regions: DataFrame, n_queries: int) -> DataFrame:
    """Rows of regions with query_index, the query a region is for, and answered, all that match in it."""
    most = F.array_position("per_query", F.array_max("per_query")).cast("int") - 1
    answered = F.filter(F.sequence(F.lit(0), F.lit(n_queries - 1)), lambda i: F.element_at("per_query", i + 1) > 0)
    return regions.withColumn("query_index", F.coalesce("declaring", most)).withColumn("answered", answered).withColumn("is_declaration", F.col("declaring").isNotNull())


def span_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n")
