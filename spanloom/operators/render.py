"""Spans as text, editor lines and JSON. Columns first; only the final joining of rows is the driver's."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fetch import anchor

DIM, BOLD, RESET = "\x1b[2m", "\x1b[1m", "\x1b[0m"


def display_path(root: str, path: Column) -> Column:
    return F.when(path == "", F.lit(root)).otherwise(path if root in ("", ".") else F.concat(F.lit(root.rstrip("/") + "/"), path))


def vimgrep(spans: DataFrame, root: str = ".") -> DataFrame:
    """(path, line, col, text, rendered) for each matched line, by path and line. Needs match_columns."""
    each = spans.select("path", "start_line", F.split("text", "\n").alias("lines"), F.explode(F.arrays_zip("match_lines", "match_columns")).alias("m"))
    text = F.coalesce(F.try_element_at("lines", (F.col("m.match_lines") - F.col("start_line") + 1).cast("int")), F.lit(""))
    rows = each.select("path", F.col("m.match_lines").alias("line"), F.coalesce("m.match_columns", F.lit(1).cast("long")).alias("col"), text.alias("text"))
    return rows.withColumn("rendered", F.concat_ws(":", display_path(root, F.col("path")), "line", "col", "text")).orderBy("path", "line")


def header(color: bool = False, queries: bool = False) -> Column:
    dim, bold, reset = (DIM, BOLD, RESET) if color else ("", "", "")
    named = F.when(F.col("symbol").isNotNull() & F.col("kind").isNotNull(), F.concat(F.lit(f" {dim}("), "kind", F.lit(" "), "symbol", F.lit(f"){reset}"))).otherwise("")
    out = [F.lit(bold), anchor(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(reset), named, F.format_string(f" {dim}[%d tok]{reset}", "tokens")]
    return F.concat(*out, *([F.concat(F.lit(f" {dim}for "), "query", F.lit(reset))] if queries else []))


def reasons(color: bool = False) -> Column:
    dim, reset = (DIM, RESET) if color else ("", "")
    parts = [F.col(f"why.{x}") for x in ("matches", "terms", "path", "depth_penalty")]
    line = F.format_string(f"{dim}  why matches %.2f + terms %.2f + path %.2f - depth %.2f = %.2f", *parts, parts[0] + parts[1] + parts[2] - parts[3])
    return F.concat(line, F.when(F.col("is_declaration"), ", declaration").otherwise(""), F.lit(reset))


def source(line_numbers: bool = False, color: bool = False) -> Column:
    """A span's lines; numbered, or with the matched ones marked."""
    if not line_numbers and not color:
        return F.col("text")

    def one(x: Column, i: Column) -> Column:
        n = F.col("start_line") + i
        hit = F.array_contains("match_lines", n)
        out = F.concat(F.when(hit, F.lit(BOLD)).otherwise(""), x, F.when(hit, F.lit(RESET)).otherwise("")) if color else x
        return F.concat(F.lpad(n.cast("string"), 6, " "), F.when(hit, ":").otherwise("-"), out) if line_numbers else out

    return F.array_join(F.transform(F.split("text", "\n"), one), "\n")


def rendered(spans: DataFrame, text: bool = True, line_numbers: bool = False, why: bool = False, queries: bool = False, color: bool = False) -> DataFrame:
    """spans with block, each span's text as it is shown."""
    parts = [header(color, queries), *([reasons(color)] if why and "why" in spans.columns else []), *([source(line_numbers, color)] if text else [])]
    return spans.withColumn("block", F.concat_ws("\n", *parts))


def to_text(spans: DataFrame, text: bool = True, **style: bool) -> str:
    """All blocks in order, apart by an empty line, ending in one newline. The result of a search is bounded by its budget."""
    blocks = [r[0] for r in rendered(spans, text=text, **style).select("block").toLocalIterator()]
    return ("\n\n" if text else "\n").join(b.rstrip("\n") if i + 1 == len(blocks) else b for i, b in enumerate(blocks)) + "\n" if blocks else ""


def json_rows(spans: DataFrame) -> DataFrame:
    """(json) for each span, null fields included."""
    return spans.select(F.to_json(F.struct(*spans.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_json(spans: DataFrame) -> str:
    return json.dumps([json.loads(r[0]) for r in json_rows(spans).toLocalIterator()], indent=2, ensure_ascii=False)


def stats(spans: DataFrame, max_tokens: int | None) -> str:
    n, used = spans.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return f"{n} spans, {used}/{'unlimited' if max_tokens is None else max_tokens} tokens"
