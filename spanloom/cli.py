"""The command line: python -m spanloom PATTERN [PATH]."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .functions import tables as T
from .operators import fetch, render
from .plans.options import Options
from .plans.search import Result, search
from .sources import corpus

FOUND, NOTHING, FAILED = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spanloom", description="Which pieces of a tree to read for a pattern, best first, within a token budget.")
    p.add_argument("pattern", nargs="?", help="a regular expression; the path where -e or --fetch is given")
    p.add_argument("path", nargs="?", help="a folder or file, the current folder by default")
    p.add_argument("-e", "--regexp", action="append", default=[], metavar="PATTERN", help="a pattern; may be repeated")
    match = p.add_argument_group("matching")
    match.add_argument("-F", "--fixed-strings", action="store_true", help="patterns are plain strings")
    match.add_argument("-w", "--word-regexp", action="store_true", help="only whole words")
    match.add_argument("-i", "--ignore-case", action="store_true")
    match.add_argument("-C", "--comments", action="store_true", help="only in comments")
    scope = p.add_argument_group("files")
    scope.add_argument("-g", "--glob", action="append", default=[], help="take paths like this, or leave out those like !this; may be repeated")
    scope.add_argument("-t", "--lang", action="append", default=[], help="languages by name, comma-separated")
    tests = scope.add_mutually_exclusive_group()
    tests.add_argument("--no-tests", dest="tests", action="store_const", const="exclude", default="include")
    tests.add_argument("--tests-only", dest="tests", action="store_const", const="only")
    listed = scope.add_mutually_exclusive_group()
    listed.add_argument("--files-from", metavar="FILE", help="only the paths that a file lists, - for standard input")
    listed.add_argument("--since", metavar="REF", help="only what changed since this branch left a git reference")
    scope.add_argument("-0", "--null", action="store_true", help="the list is separated by NUL")
    scope.add_argument("--hidden", action="store_true", help="hidden files too")
    scope.add_argument("--no-ignore", action="store_true", help="don't heed git's ignore files")
    select = p.add_argument_group("selection")
    kind = select.add_mutually_exclusive_group()
    kind.add_argument("-d", "--declarations", dest="select", action="store_const", const="declarations", default="all")
    kind.add_argument("-r", "--references", dest="select", action="store_const", const="references")
    select.add_argument("--kind", action="append", default=[], help="only declarations of these kinds, comma-separated")
    select.add_argument("--min-references", type=int, default=0, metavar="N", help="hold room for so many references")
    select.add_argument("-O", "--orphan-context", type=int, default=T.ORPHAN_CONTEXT, metavar="N", help="lines around a match outside declarations")
    budget = p.add_argument_group("budget")
    most = budget.add_mutually_exclusive_group()
    most.add_argument("-b", "--max-tokens", type=int, metavar="N", help=f"{T.MAX_TOKENS} by default, none with --vimgrep")
    most.add_argument("-a", "--no-budget", action="store_true", help="every span")
    budget.add_argument("--max-per-file", type=int, metavar="N", help=f"spans of one file: {T.MAX_PER_FILE} by default, any number (0) without a budget")
    budget.add_argument("--vocabulary", metavar="FILE", help="a .tiktoken file to count tokens by")
    show = p.add_argument_group("output")
    show.add_argument("-l", "--anchors-only", action="store_true", help="no text")
    show.add_argument("-n", "--line-numbers", action="store_true")
    form = show.add_mutually_exclusive_group()
    form.add_argument("--vimgrep", action="store_true", help="a line for each matched line")
    form.add_argument("--json", action="store_true")
    show.add_argument("--why", action="store_true", help="the parts of each score")
    show.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    show.add_argument("--fetch", action="append", default=[], metavar="ANCHOR", help="the lines of path:start-end, - for anchors on standard input")
    show.add_argument("--stats", action="store_true", help="counts and times, on standard error")
    p.add_argument("--threads", type=int, metavar="N", help="local threads; a submitted job has its cluster's")
    return p


def names(values: Iterable[str]) -> tuple[str, ...]:
    return tuple(x for v in values for x in v.split(",") if x)


def options(a: argparse.Namespace) -> Options:
    default = None if a.no_budget or a.vimgrep else T.MAX_TOKENS
    return Options(
        literal=a.fixed_strings, word=a.word_regexp, ignore_case=a.ignore_case, comments_only=a.comments, globs=tuple(a.glob), langs=names(a.lang), tests=a.tests, select=a.select, kinds=names(a.kind), min_references=a.min_references,
        orphan_context=a.orphan_context, max_tokens=default if a.max_tokens is None else a.max_tokens, max_per_file=a.max_per_file, columns=a.vimgrep, explain=a.why, vocabulary=a.vocabulary,
    )


def session(threads: int | None) -> SparkSession:
    build = SparkSession.builder.appName("spanloom")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # not submitted to a cluster
        build = build.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        build = build.config("spark.sql.shuffle.partitions", str(threads or os.cpu_count() or 8))
    return build.getOrCreate()


def listed_paths(a: argparse.Namespace, root: str, source: TextIO) -> list[str] | None:
    if a.files_from:
        if a.files_from == "-":
            data = source.read()
        else:
            with open(a.files_from, encoding="utf-8") as file:
                data = file.read()
        base = os.path.abspath(root)
        inner = lambda p: os.path.relpath(os.path.join(base, p), base).replace(os.sep, "/")
        return [inner(p) for p in corpus.split_list(data, a.null)]
    return corpus.changed_since(root, a.since) if a.since else None


def shown(spans: DataFrame, a: argparse.Namespace, root: str, several: bool, color: bool) -> str:
    if a.json:
        return render.to_json(spans) + "\n"
    if a.vimgrep:
        return "".join(r[0] + "\n" for r in render.vimgrep(spans, root).select("rendered").toLocalIterator())
    return render.to_text(spans, text=not a.anchors_only, line_numbers=a.line_numbers, why=a.why, queries=several, color=color)


def gaps(found: Result, a: argparse.Namespace, root: str, empty: bool) -> list[str]:
    """What a run found but can't show."""
    out = [f"no matches for {', '.join(found.unmatched)}"] if found.unmatched else []
    if empty and a.kind:
        out.append("nothing of that kind; a kind is the word that declares it")
    if os.path.isdir(root) and (large := corpus.list_tree(root, a.hidden, a.no_ignore)[1]):
        out.append(f"skipped {large} files over {T.MAX_FILE_BYTES >> 20} MiB")
    return out


def run(a: argparse.Namespace, spark: SparkSession | None, source: TextIO, out: TextIO, err: TextIO) -> int:
    began = time.perf_counter()
    color = a.color == "always" or a.color == "auto" and out.isatty()
    opts = options(a)
    spark = spark or session(a.threads)
    if a.fetch:
        root = a.path or a.pattern or "."
        anchors = [x for given in a.fetch for x in (fetch.anchors_from(source.read()) if given == "-" else [given])]
        wanted = [fetch.contained(fetch.parse_anchor(x)[0]) for x in anchors]
        spans = fetch.fetch(corpus.from_tree(spark, root, paths=wanted), anchors, opts.max_tokens, opts.vocabulary).cache()
        found, several = None, False
    else:
        if a.regexp and a.path:
            raise ValueError("with -e only a path may be given besides")
        if not a.regexp and a.pattern is None:
            raise ValueError("no pattern; see --help")
        patterns, root = (a.regexp, a.pattern or ".") if a.regexp else ([a.pattern], a.path or ".")
        if not os.path.exists(root) and "://" not in root:
            raise FileNotFoundError(f"no such path: {root}")
        files = corpus.from_tree(spark, root, a.hidden, a.no_ignore, listed_paths(a, root, source))
        found, several = search(files, patterns, opts), len(patterns) > 1
        spans = found.spans.cache()
    planned = time.perf_counter()
    n = spans.count()
    ran = time.perf_counter()
    text = shown(spans, a, root, several, color) if n or a.json else ""
    try:
        out.write(text)
        out.flush()
    except BrokenPipeError:  # the reader has what it wanted
        if out is sys.stdout:
            os.dup2(os.open(os.devnull, os.O_WRONLY), out.fileno())
    done = time.perf_counter()
    if found:
        for line in gaps(found, a, root, not n):
            print(f"spanloom: {line}", file=err)
        if a.stats:
            matched, read = found.counts()
            ms = lambda s: f"{1000 * s:.1f}ms"
            print(f"spanloom: {render.stats(spans, opts.max_tokens)}, {ms(done - began)} total", file=err)
            print(f"spanloom: scout and plan {ms(planned - began)} ({matched} files matched), extract and pack {ms(ran - planned)} ({read} files read)", file=err)
            print(f"spanloom: render {ms(done - ran)}", file=err)
        found.release()
    spans.unpersist()
    return FOUND if n else NOTHING


def main(argv: list[str] | None = None, spark: SparkSession | None = None, source: TextIO | None = None, out: TextIO | None = None, err: TextIO | None = None) -> int:
    """0 if something was found, 1 if nothing, 2 if the question or the writing failed."""
    source, out, err = source or sys.stdin, out or sys.stdout, err or sys.stderr
    p = parser()
    try:
        a = p.parse_args(argv)
        if a.null and not a.files_from:
            p.error("-0 needs --files-from")
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(a, spark, source, out, err)
    except (ValueError, OSError) as e:
        print(f"spanloom: {e}", file=err)
        return FAILED
