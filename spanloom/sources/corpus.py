"""Corpora: DataFrames of (path, content) from folders, tables, lists of paths and changes."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import MAX_FILE_BYTES


def from_table(df: DataFrame, path: Column, content: str = "text") -> DataFrame:
    """Any table with a text column; rows without text are left out."""
    return df.select(path.alias("path"), F.col(content).alias("content")).filter(F.col("content").isNotNull())


class IgnoreRules:
    """The ignore files of a tree, later and deeper rules winning."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str, str, bool, bool]] = []

    def read(self, folder: str, file: str, base: str = "") -> None:
        """folder: the file's own, below the root; base: the root's place below the file's folder, where that is above."""
        if os.path.isfile(file):
            with open(file, encoding="utf-8", errors="replace") as lines:
                for line in map(str.rstrip, lines):
                    if line and line[0] != "#":
                        keep = line[0] == "!"
                        rule = line[keep:].removeprefix("\\")
                        self.rules.append((folder, base, rule.rstrip("/"), keep, rule.endswith("/")))

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for folder, base, rule, keep, only_dirs in self.rules:
            inner = path.removeprefix(folder + "/") if folder else f"{base}/{path}" if base else path
            if (folder and inner == path) or (only_dirs and not is_dir):
                continue
            if "/" in rule:
                hit = re.fullmatch(X.glob_regex("/" + rule.lstrip("/")), inner) is not None
            else:
                hit = fnmatch.fnmatchcase(inner.rsplit("/", 1)[-1], rule)
            if hit:
                out = not keep
        return out

    def read_above(self, root: str, git: bool) -> None:
        """The user's own excludes, and the ignore files of the folders above the root: git's as far as its repository goes."""
        root = os.path.realpath(root)
        above = [root]
        while (parent := os.path.dirname(above[-1])) != above[-1]:
            above.append(parent)
        top = next((i for i, d in enumerate(above) if os.path.exists(os.path.join(d, ".git"))), None)
        if git and top is not None:
            base = os.path.relpath(root, above[top]).replace(os.sep, "/")
            base = "" if base == "." else base
            self.read("", user_excludes(root), base)
            if top:
                self.read("", os.path.join(above[top], ".git", "info", "exclude"), base)
        for i, folder in reversed([*enumerate(above)][1:]):
            base = os.path.relpath(root, folder).replace(os.sep, "/")
            self.read("", os.path.join(folder, ".ignore"), base)
            if git and top is not None and i <= top:
                self.read("", os.path.join(folder, ".gitignore"), base)


def user_excludes(root: str) -> str:
    """The file of excludes that holds in all of a user's repositories."""
    try:
        told = subprocess.run(["git", "-C", root, "config", "--type=path", "core.excludesFile"], capture_output=True, text=True).stdout.strip()
    except OSError:
        told = ""
    return told or os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def list_tree(root: str, hidden: bool = False, no_ignore: bool = False, max_bytes: int = MAX_FILE_BYTES) -> tuple[list[str], int]:
    """Root-relative paths of a local tree, and how many files were too large."""
    if not os.path.exists(root):
        raise FileNotFoundError(f"no such path: {root}")
    rules, out, large = IgnoreRules(), [], 0
    rules.read_above(root, not no_ignore)
    for folder, dirs, files in os.walk(root):
        here = "" if (inner := os.path.relpath(folder, root).replace(os.sep, "/")) == "." else inner
        at = lambda name: f"{here}/{name}" if here else name  # noqa: B023, E731
        rules.read(here, os.path.join(folder, ".ignore"))
        if not no_ignore:
            rules.read(here, os.path.join(folder, ".gitignore"))
            if not here:
                rules.read("", os.path.join(folder, ".git", "info", "exclude"))
        dirs[:] = sorted(d for d in dirs if (hidden or d[0] != ".") and d != ".git" and not rules.ignored(at(d), True))
        for name in sorted(files):
            if (hidden or name[0] != ".") and not rules.ignored(at(name), False):
                if os.path.getsize(os.path.join(folder, name)) > max_bytes:
                    large += 1
                else:
                    out.append(at(name))
    return out, large


def from_tree(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, paths: list[str] | None = None) -> DataFrame:
    """The text files of a tree. Files over 8 MiB are pruned before they are read; files that are not UTF-8 are left out.

    A local tree is listed here, by its ignore rules; elsewhere Spark lists it, with the hidden filter alone. An
    explicit list of paths overrides both rules; an empty one reads nothing.
    """
    local = os.path.exists(root)
    if not local and "://" not in root:
        raise FileNotFoundError(f"no such path: {root}")
    if local:
        base = os.path.abspath(root)
        kept = list_tree(base, hidden or paths is not None, no_ignore or paths is not None)[0] if os.path.isdir(base) else [""]
        if paths is not None:
            there = set(kept)
            kept = [p for p in dict.fromkeys(paths) if p in there]
        if not kept:
            return spark.createDataFrame([], "path string, content string, size bigint")
        files = spark.read.format("binaryFile").load([os.path.join(base, p) if p else base for p in kept])
        prefix = f"file:{base}"
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        prefix = root
    path = F.regexp_replace(F.substring("path", len(prefix.rstrip("/")) + 1, 1 << 30), "^/+", "")
    files = files.filter(F.col("length") <= MAX_FILE_BYTES).filter(F.is_valid_utf8(F.col("content").cast("string")))
    files = files.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))
    if not local:
        if not hidden and paths is None:
            files = files.filter(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))
        if paths is not None:
            files = keep_paths(files, paths)
    return files


def split_list(data: str, null: bool = False) -> list[str]:
    """Paths of a list: one a line, or NUL-separated."""
    return [x for x in (data.split("\0") if null else (y.removesuffix("\r") for y in data.split("\n"))) if x]


def keep_paths(files: DataFrame, paths: list[str]) -> DataFrame:
    """Only the files listed; an empty list keeps none."""
    if not paths:
        return files.limit(0)
    wanted = files.sparkSession.createDataFrame([(p.removeprefix("./"),) for p in dict.fromkeys(paths)], "path string")
    return files.join(wanted, "path", "left_semi")


def changed_since(root: str, reference: str) -> list[str]:
    """Root-relative paths that differ from where this branch left `reference`, and untracked ones."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        if done.returncode:
            raise ValueError(done.stderr.strip() or f"git {args[0]} failed")
        return done.stdout

    fork = git("merge-base", reference, "HEAD").strip()
    changed = git("diff", "--name-only", "--relative", "-z", fork)
    fresh = git("ls-files", "--others", "--exclude-standard", "-z")
    return list(dict.fromkeys(split_list(changed, True) + split_list(fresh, True)))
