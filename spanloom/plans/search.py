"""The search plan: scout, rank, extract, score, select, pack."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.declare import with_declarations
from ..functions.durable import cut
from ..operators import match, pack, rank, regions
from ..sources.corpus import keep_paths
from .options import Options
from .patterns import Query, compile_patterns


@dataclass
class Result:
    """spans in their order; patterns that no span answered, named only if there are several patterns; what the counts are taken from."""

    spans: DataFrame
    queries: list[Query]
    options: Options
    unmatched: list[str] = field(default_factory=list)
    scouted: DataFrame | None = None
    gathered: DataFrame | None = None
    #: Tables that the search keeps until release().
    held: list[DataFrame] = field(default_factory=list)

    @property
    def exit_status(self) -> int:
        return 1 if self.spans.isEmpty() else 0

    def counts(self) -> tuple[int, int]:
        """How many files matched, and how many of them gave spans to choose from."""
        return self.scouted.select("path").count(), self.gathered.select("path").distinct().count()

    def release(self) -> None:
        """Lets go of what the search keeps; its spans can still be read, by running it again."""
        for df in self.held:
            df.unpersist()
        self.held.clear()


def extract(files: DataFrame, queries: list[Query], options: Options) -> DataFrame:
    """The spans of candidate files, scored but for the depth penalty. Up to the text of each span all happens within a file's row: nothing is shuffled."""
    files = with_declarations(match.attributed(files, queries, options.match_cap))
    files = regions.merge(regions.windows(files, queries, options), len(queries))
    keep = [c for c in ("candidate_rank", "file_key") if c in files.columns]

    def whole(r: Column) -> Column:
        text = regions.span_text(F.col("lines"), r["start"], r["end"])
        columns = F.transform(r["match_lines"], lambda n: match.first_columns(queries, F.element_at("shown", n.cast("int"))))
        more = {"text": text, **({"match_columns": columns} if options.columns else {})}
        return F.struct(r["start"].alias("start_line"), r["end"].alias("end_line"), *(r[c].alias(c) for c in ("symbol", "kind", "depth", "match_lines", "per_query", "declaring")), *(v.alias(k) for k, v in more.items()))

    # The text is cut before rows are made, so that no row carries its whole file.
    spans = files.select("path", "path_scores", *keep, F.explode(F.transform("regions", whole)).alias("r")).select("path", "path_scores", *keep, "r.*")
    spans = regions.owned(spans, len(queries))
    tokens = X.bpe_counter(options.vocabulary)("text") if options.vocabulary else X.token_pieces(F.col("text"))
    spans = spans.withColumn("tokens", tokens).withColumn("query", rank.per_query(queries, lambda q: F.lit(q.pattern)))
    return rank.scored(spans, queries)


def _chosen(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """The files of ranks (path, file_key, candidate_rank), of checked number."""
    same = files["path"].eqNullSafe(ranks["path"]) & (files["file_key"] == ranks["file_key"])
    return files.join(F.broadcast(ranks), same).select(files["path"], files["content"], ranks["candidate_rank"])


def _head(files: DataFrame, narrow: DataFrame, held: list[DataFrame]) -> tuple[DataFrame, int]:
    """The best T.CHUNK files with their contents, and their number: one scan, as contents up to T.CARRIED bytes travel with the ranking; longer ones are fetched."""
    spark = files.sparkSession
    best = narrow.orderBy(*match.candidate_order(True)).limit(T.CHUNK).cache()
    held.append(best)
    ranked = best.withColumn("candidate_rank", F.row_number().over(Window.orderBy(*match.candidate_order(True))))
    n, fetched = best.agg(F.count("*"), F.count_if(F.col("carried").isNull())).first()
    out = ranked.filter("carried is not null").select("path", F.col("carried").alias("content"), "candidate_rank").repartition(spark.sparkContext.defaultParallelism)
    if fetched:
        out = out.unionByName(_chosen(files, ranked.filter("carried is null").select("path", "file_key", "candidate_rank")))
    return out, n


def gathered(files: DataFrame, scouted: DataFrame, queries: list[Query], options: Options, held: list[DataFrame]) -> DataFrame:
    """Spans of as many of the best files as the budget asks for: the best 256 first, then more while it asks on.

    The first step needs one scan of the files. For later ones keys are ranked once for two steps and meet the files
    before these are split into lines; the files chosen are kept, so that a second step scans nothing. A pattern that
    never gets its share asks for all files: beyond T.WIDE of them, keys are no longer gathered and all candidates are
    ranked and read where they are. Rows of equal path and content are one file.
    """
    if options.max_tokens is None:
        return extract(scouted, queries, options)
    n, spark = len(queries), files.sparkSession
    share = max(1, T.OVERSAMPLE * options.max_tokens // n)
    key = F.xxhash64("path", "content")
    files = files.withColumn("file_key", key)
    carried = F.when(F.octet_length("content") <= T.CARRIED, F.col("content"))
    narrow = scouted.select("path", key.alias("file_key"), "declaration_hint", "match_count", "best_path", carried.alias("carried"))
    size, reach, best, kept = T.CHUNK, T.CHUNK, [], None
    while size <= T.WIDE:
        if size == T.CHUNK:
            chosen, count = _head(files, narrow, held)
            last = count < T.CHUNK
        else:
            if size > reach:
                reach = 4 * size
                best = narrow.orderBy(*match.candidate_order(True)).limit(reach).select("path", "file_key").collect()
                best = list(dict.fromkeys(map(tuple, best)))
                ranks = spark.createDataFrame([(*x, i) for i, x in enumerate(best, 1)], "path string, file_key long, candidate_rank int")
                kept = _chosen(files, ranks).cache()
                held.append(kept)
            chosen = kept.filter(F.col("candidate_rank") <= size)
            last = len(best) < reach and len(best) <= size
        spans = extract(match.candidates(match.with_lines(chosen, options), queries), queries, options).cache()
        held.append(spans)
        if not last:
            spent = {r["query_index"]: r["t"] for r in spans.groupBy("query_index").agg(F.sum("tokens").alias("t")).collect()}
        if last or all(spent.get(q, 0) >= share for q in range(n)):
            return pack.budget_gate(spans, n, options.max_tokens)
        spans.unpersist()
        size *= 4
        if kept is not None and size > reach:
            kept.unpersist()
    ranks = rank.placed(narrow.drop("carried").distinct(), [], match.candidate_order(True), "candidate_rank").select("path", "file_key", "candidate_rank")
    spans = extract(scouted.withColumn("file_key", key), queries, options)
    return cut(pack.budget_gate(cut(spans.join(ranks.withColumnsRenamed({"path": "__sl_path"}), "file_key").filter(F.col("path").eqNullSafe(F.col("__sl_path"))).drop("file_key", "__sl_path")), n, options.max_tokens))


COLUMNS = ["path", "start_line", "end_line", "symbol", "kind", "match_lines", "match_columns", "is_declaration", "depth", "query", "tokens", "score", "why", "text"]


def search(corpus: DataFrame, patterns: list[str], options: Options = Options()) -> Result:
    """Ranked spans of a corpus of (path, content)."""
    queries = compile_patterns(corpus.sparkSession, patterns, options)
    files = match.path_filters(corpus.select("path", "content"), options)
    if options.paths is not None:
        files = keep_paths(files, list(options.paths))
    scouted = match.candidates(match.scout(match.with_lines(files, options), queries, options.comments_only), queries)
    held: list[DataFrame] = []
    found = gathered(files, scouted, queries, options, held)
    spans = rank.shadowed(found)
    unmatched: list[str] = []
    if len(queries) > 1:
        spans = spans.cache()
        held.append(spans)
        answered = {r[0] for r in spans.select(F.explode("answered")).distinct().collect()}
        unmatched = [q.pattern for q in queries if q.index not in answered]
    if options.declarations_only:
        spans = spans.filter("is_declaration")
    if options.select == "references":
        spans = spans.filter("not is_declaration")
    if options.kinds:
        spans = spans.filter(F.col("kind").isin(*options.kinds))
    n = len(queries)
    # A budget keeps spans few unless a pattern never gets its share; then, or without one, a lane may be of any size.
    few = options.max_tokens is not None and spans.count() <= pack.AT_ONCE
    spans, order = rank.interleaved(spans, n, few), rank.output_order(n)
    if options.max_tokens is None:
        spans = pack.capped(spans, options.cap, order)
    else:
        spans = pack.pack(spans, options.max_tokens, options.cap, options.min_references, order, few)
    shown = [c for c in COLUMNS if c in spans.columns and (c != "why" or options.explain)]
    return Result(spans.orderBy(*order).select(*shown), queries, options, unmatched, scouted, found, held)
