"""Scalar functions of lines, names and paths as Column expressions."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

SEPARATOR = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|[^\p{L}\p{N}]+"


def lines(content: Column) -> Column:
    """The array of a text's lines: no line after a final newline, no carriage return directly before a newline or the end."""
    parts = F.split(content, "\r?\n")
    kept = F.slice(parts, F.lit(1), F.size(parts) - 1)
    last = F.element_at(parts, -1)
    return F.when(last == "", kept).otherwise(F.concat(kept, F.array(F.regexp_replace(last, r"\r\z", ""))))


def indent(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.ltrim(line, F.lit(" \t")))


def closes_body(line: Column) -> Column:
    return line.rlike(r"^[ \t]*(end|[)\]};,]+)[ \t]*$")


def identifier_parts(name: Column) -> Column:
    """Camel, snake and kebab parts in lower case; digits apart."""
    return F.filter(F.transform(F.split(name, SEPARATOR), F.lower), lambda x: x != "")


def identifier_tokens(name: str) -> list[str]:
    import regex

    return [x.lower() for x in regex.split(SEPARATOR, name, flags=regex.V1) if x]


def query_terms(pattern: str) -> list[str]:
    """The parts and wholes of a pattern's words, once each, in order."""
    out: dict[str, None] = {}
    for word in re.findall(r"\w+", pattern):
        for x in [*identifier_tokens(word), word.lower()]:
            out.setdefault(x)
    return list(out)


def low(text: Column) -> Column:
    """Lower case letter by letter: a sigma at a word's end is no other letter."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_score(path: Column, terms: Column) -> Column:
    """1 for a file named by a term; else the share of the name's parts that are terms."""
    stem = F.substring_index(file_name(path), ".", 1)
    parts = identifier_parts(stem)
    share = F.size(F.filter(parts, lambda x: F.array_contains(terms, x))) / F.size(parts)
    return F.when(F.array_contains(terms, F.lower(stem)), 1.0).when((F.size(terms) > 0) & (F.size(parts) > 0), share).otherwise(0.0)


def term_overlap(text: Column, terms: Column) -> Column:
    lowered = low(text)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(lowered, t))) / F.size(terms)).otherwise(0.0)


def looks_like_test(path: Column) -> Column:
    """By its folders, or its name less the last extension."""
    name = file_name(path)
    folders = F.split(F.lower(F.substring(path, F.lit(1), F.length(path) - F.length(name))), "/")
    stem = F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    low = F.lower(stem)
    out = F.exists(folders, lambda d: d.isin(T.TEST_DIRS)) | low.isin(T.TEST_STEMS)
    for x in T.TEST_ENDINGS:
        out |= low.endswith(x)
    for x in T.TEST_STARTS:
        out |= low.startswith(x)
    for x in T.TEST_CAMEL:
        out |= stem.endswith(x)
    return out


def extensions(langs: list[str]) -> list[str]:
    unknown = [x for x in langs if x not in T.LANGUAGES]
    if unknown:
        raise ValueError(f"unknown language {unknown[0]}; known: {', '.join(T.LANGUAGES)}")
    return list(dict.fromkeys(e for x in langs for e in T.LANGUAGES[x]))


def has_extension(path: Column, wanted: list[str]) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)).isin(wanted)


def glob_regex(glob: str) -> str:
    """A path glob as a regex: `**` crosses folders, `*` and `?` don't; without a slash it holds for names anywhere."""
    out, i = "" if "/" in glob.rstrip("/") else "(?:.*/)?", 0
    glob = glob.lstrip("/")
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(re.escape(x).replace(r"\*", "[^/]*") for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            if c in "[{":
                raise ValueError(f"bad glob: {glob}")
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def glob_filter(path: Column, globs: list[str]) -> Column:
    """The last glob that matches decides, `!` excluding; with an including glob, paths that none matches are out."""
    keep = F.lit(all(g.startswith("!") for g in globs))
    for g in globs:
        keep = F.when(path.rlike(f"^{glob_regex(g.removeprefix('!'))}(?:/.*)?$"), F.lit(not g.startswith("!"))).otherwise(keep)
    return keep


def byte_column(line: Column, pattern: str) -> Column:
    """The 1-based byte at which a pattern first matches; 1 where it doesn't."""
    at = F.regexp_instr(line, F.lit(pattern))
    return F.when(at > 0, F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1).otherwise(1).cast("long")


def token_pieces(text: Column, exact: bool = False) -> Column:
    """Pieces of the published token split: a lower bound of a text's tokens, for want of a vocabulary."""
    return F.size(F.regexp_extract_all(text, F.lit(T.TOKEN_PIECES_EXACT if exact else T.TOKEN_PIECES), F.lit(0))).cast("long")


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a `.tiktoken` vocabulary file, read where the search is planned."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in file if x.strip())}


_encodings: dict[bytes, object] = {}


def bpe_counter(vocabulary: str | dict[bytes, int], limit: int | None = None):
    """Counts tokens by a vocabulary (its ranks, or the path of a `.tiktoken` file), `limit` standing for more, as a pandas UDF.

    The ranks travel with the function, so that no executor reads a local file.
    """
    ranks = ranks_of(vocabulary) if isinstance(vocabulary, str) else vocabulary
    packed = zlib.compress(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()))
    mark = hashlib.sha256(packed).digest()

    def load():
        if mark not in _encodings:
            import tiktoken

            own = {base64.b64decode(a): int(b) for a, b in (x.split() for x in zlib.decompress(packed).split(b"\n") if x)}
            _encodings[mark] = tiktoken.Encoding("vocabulary", pat_str=T.TOKEN_PIECES_EXACT, mergeable_ranks=own, special_tokens={})
        return _encodings[mark]

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = load()
        most = (lambda n: n) if limit is None else (lambda n: min(n, limit))
        return pd.Series([None if t is None else most(len(e.encode_ordinary(t))) for t in texts], dtype="Int64")

    return count
