"""How well spans are ranked: symbols to ask for, a plain line search as the baseline, and measures of both.

Asked for a symbol, a search should name the file that declares it first, and within a token budget as many as it can of
the files that mention it. Truth comes from declarations as each language's own regexes tell them, not from the engine.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import metrics
from .options import Options
from .search import search

WORD = r"[A-Za-z_]\w*"


@dataclass(frozen=True)
class Language:
    """endings of its files, and regexes of its declarations with the name as their group."""

    endings: tuple[str, ...]
    definitions: tuple[str, ...]


#: What a reader of each language would grep for.
LANGUAGES = {
    "python": Language(("py", "pyi"), (rf"^\s*(?:async\s+def|def|class)\s+({WORD})", rf"^({WORD})\s*=\s*lambda\b")),
    "rust": Language(("rs",), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:unsafe|async|const|extern)\s+)*(?:fn|struct|enum|trait|type|mod|static)\s+({WORD})",)),
    "script": Language(("js", "jsx", "ts", "tsx"), (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|enum|type)\s+({WORD})", rf"^\s*(?:(?:export\s+)?(?:const|let|var)\s+)?({WORD})\s*=\s*(?:async\s+)?(?:\([^)]*\)|{WORD})\s*=>")),
    "go": Language(("go",), (rf"^func\s+(?:\([^)]*\)\s*)?({WORD})\s*\(", rf"^type\s+({WORD})\s", rf"^(?:static\s+)?{WORD}[\s*]+({WORD})\([^;]*\{{\s*$")),
}


def mentions(files: DataFrame) -> DataFrame:
    """(path, line_no, symbol, is_definition) of every word of every line, once a line. A line tells its own words; nothing is shuffled."""
    ending = F.lower(F.regexp_extract(X.file_name(F.col("path")), r"\.([^.]*)$", 1))
    line = F.col("text")
    told: list[Column] = [F.when(ending.isin(*lang.endings) & line.rlike(p), F.regexp_extract(line, p, 1)) for lang in LANGUAGES.values() for p in lang.definitions]
    lines = files.select("path", F.posexplode(X.lines(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "text", F.array_compact(F.array(*told)).alias("told"))
    words = lines.select("path", "line_no", "told", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("symbol"))
    return words.select("path", "line_no", "symbol", F.array_contains("told", F.col("symbol")).alias("is_definition"))


def symbols(told: DataFrame, limit: int, seed: int) -> DataFrame:
    """(symbol, path, neighborhood): a seeded sample of symbols worth asking for, where each is declared, and all files that name it."""
    index = metrics.symbol_index(told.select("symbol", "path", "is_definition").distinct())
    worth = metrics.query_symbols(index).join(index.select("symbol", "references"), "symbol")
    sample = worth.orderBy(F.md5(F.concat("symbol", F.lit(f":{seed}"))), "symbol").limit(limit)
    return sample.select("symbol", "path", F.array_sort(F.array_union(F.array("path"), "references")).alias("neighborhood"))


def baseline(files: DataFrame, told: DataFrame, names: DataFrame, context: int = 2) -> DataFrame:
    """(query, rank, path, cost): files with lines that match a name as a word, declaring ones first, then by lines and path; charged for these lines and those around them.

    names (symbol) is a sample of checked size. Files meet it by the words of their lines, and only lines near a match are kept.
    """
    hits = told.join(F.broadcast(names.select("symbol")), "symbol")
    of = hits.groupBy("symbol", "path").agg(F.count("*").alias("n"), F.max("is_definition").alias("declares"), F.collect_set("line_no").alias("lines"))
    met = of.join(files.select("path", X.lines(F.col("content")).alias("all")), "path")
    near = F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda n: F.sequence(F.greatest(F.lit(1).cast("long"), n - context), F.least(n + context, F.size("all").cast("long")))))))
    region = F.array_join(F.transform(near, lambda n: F.element_at("all", n.cast("int"))), "\n")
    from pyspark.sql import Window

    order = Window.partitionBy("symbol").orderBy(F.desc("declares"), F.desc("n"), "path")
    return met.select("symbol", "path", F.row_number().over(order).alias("rank"), X.token_pieces(region).alias("cost")).select(F.col("symbol").alias("query"), "rank", "path", "cost")


def system(files: DataFrame, names: list[str], max_tokens: int) -> tuple[DataFrame, dict[str, float]]:
    """(query, rank, path, cost): the spans a search returns in their order, and its seconds by name."""
    out, took = None, {}
    for name in names:
        began = time.perf_counter()
        found = search(files, [re.escape(name)], Options(word=True, max_tokens=max_tokens)).spans.select("path", "tokens").collect()  # bounded by the budget
        took[name] = time.perf_counter() - began
        rows = files.sparkSession.createDataFrame([(name, i, r["path"], r["tokens"]) for i, r in enumerate(found, 1)], "query string, rank int, path string, cost long")
        out = rows if out is None else out.unionByName(rows)
    return out, took


def measure(ranked: DataFrame, asked: DataFrame, max_tokens: int) -> DataFrame:
    """(query, mrr, defined, coverage): of the declaring file's place, whether it is within the budget, and the share of the neighborhood that is."""
    truth = asked.select(F.col("symbol").alias("query"), "path")
    near = asked.select(F.col("symbol").alias("query"), F.explode("neighborhood").alias("path"))
    kept = metrics.under_budget(ranked, max_tokens)
    defined = truth.join(kept.distinct(), ["query", "path"], "left_semi").select("query", F.lit(1).alias("defined"))
    out = metrics.mrr(ranked, truth).join(metrics.coverage(kept, near), "query").join(defined, "query", "left")
    return out.select("query", "mrr", F.coalesce("defined", F.lit(0)).alias("defined"), "coverage")


def report(measures: DataFrame) -> DataFrame:
    """One row: how many were asked, and the means."""
    return measures.agg(F.count("*").alias("asked"), *(F.avg(c).alias(c) for c in ("mrr", "defined", "coverage")))


def losses(base: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """(query, gap): where the baseline ranks better, worst first."""
    gap = base.select("query", F.col("mrr").alias("base")).join(own.select("query", "mrr"), "query").select("query", (F.col("base") - F.col("mrr")).alias("gap"))
    return gap.filter("gap > 0").orderBy(F.desc("gap"), "query").limit(limit)
