"""Patterns as Java regexes: the pattern syntax where both agree, translated where they differ, refused where Java has no equal."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.text import query_terms
from .options import Options

#: The ASCII classes in brackets, and the long names of general categories.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
CATEGORIES = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "casedletter": "LC", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl",
    "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
#: A piece of a pattern: an escape, a group's head, a class in brackets, a repetition, or one character.
PIECE = re.compile(r"\\[pP]\{\^?[^}]*\}|\\[pP].|\\[xuU]\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\b\{[^}]*\}|\\.|\[:\^?[a-z]+:\]|\(\?P?<[A-Za-z_][\w.\[\]]*>|\(\?[A-Za-z-]*[:)]|\(\?|(?:[*+?]|\{[0-9]*,?[0-9]*\})\??[*+?]?|&&|--|~~|.", re.S)
#: The letters that may stand after a backslash.
ESCAPES = frozenset("dDsSwWbBAzafnrtv")


@dataclass(frozen=True)
class Query:
    index: int
    pattern: str
    regex: str
    terms: tuple[str, ...]
    #: Whether it asks for a line's start or end.
    anchored: bool = False


def _property(piece: str) -> str:
    name, negated = piece[2:], piece[1] == "P"
    if name[0] == "{":
        name = name[1:-1]
    if name.startswith("^"):
        name, negated = name[1:], not negated
    kind, _, value = re.sub(r"\s", "", name).replace("!=", "=^").replace(":", "=").rpartition("=")
    if value.startswith("^"):
        value, negated = value[1:], not negated
    plain = re.sub(r"[_-]", "", value).lower()
    if kind.lower() in ("sc", "script"):
        out = f"script={value}"
    elif kind.lower() in ("", "gc", "generalcategory") and (plain in CATEGORIES or len(value) <= 2):
        out = CATEGORIES.get(plain, value[:1].upper() + value[1:].lower())
    elif plain == "any":
        return r"[^\x{0}-\x{10FFFF}]" if negated else r"[\x{0}-\x{10FFFF}]"
    elif plain == "ascii":
        return r"[^\x00-\x7F]" if negated else r"[\x00-\x7F]"
    elif kind:
        raise ValueError(f"{piece!r} is not supported")
    else:
        out = f"Is{value}"
    return f"\\{'P' if negated else 'p'}{{{out}}}"


def _flags(text: str) -> str:
    on, _, off = text.partition("-")
    if set(on + off) - set("imsxu"):
        raise ValueError(f"(?{text}) is not supported")
    of = lambda x: "".join({"i": "iu", "u": "U"}.get(c, c) for c in x)
    return of(on) + ("-" + of(off) if off else "")


def _translated(pattern: str) -> Iterator[str]:
    depth, opened = 0, False
    for m in PIECE.finditer(pattern):
        x = m[0]
        refused = ValueError(f"{x!r} is not supported in a pattern: {pattern}")
        if x[0] == "\\":
            c = x[1:2]
            if c in ("p", "P"):
                yield _property(x)
            elif c in "xuU" and c and len(x) > 2:
                yield f"\\x{{{x[2:].strip('{}')}}}"
            elif c == "v":
                yield r"\x0B"
            elif c in ("<", ">") and not depth:
                yield r"(?<!\w)(?=\w)" if c == "<" else r"(?<=\w)(?!\w)"
            elif not c or c.isalnum() and (c not in ESCAPES or len(x) > 2):
                raise refused
            else:
                yield x
            opened = False
        elif depth:
            if x[:2] == "[:" and len(x) > 2:
                name = x[2:-2]
                if name.lstrip("^") not in POSIX:
                    raise refused
                yield f"[^{POSIX[name[1:]]}]" if name[0] == "^" else POSIX[name]
            elif x in ("--", "~~"):
                raise refused
            elif x == "[":
                depth += 1
                yield x
            elif x == "]" and not opened:
                depth -= 1
                yield x
            elif x[0] == "^" and opened:
                yield x
                continue
            elif x == "&&":
                yield x
            else:  # what is special in Java's brackets alone, and pieces of several characters
                yield "".join("\\" + c if c in "[]&#" or c == " " else c for c in x)
            opened = x == "["
        elif x == "[" or x[:2] == "[:":
            depth, opened = 1, True
            yield "["
            if len(x) > 1:
                raise refused
        elif x[:2] == "(?":
            if x == "(?":
                raise refused
            if x[-1] == ">":
                yield "(?:"
            else:
                yield f"(?{_flags(x[2:-1])}{x[-1]}"
        elif x[0] in "*+?{" and len(x) > 1 and x[-1] in "*+?" and not re.fullmatch(r"(?:[*+?]|\{[0-9]*,?[0-9]*\})\??", x):
            raise refused
        elif x[0] == "{" and re.fullmatch(r"\{,[0-9]+\}\??", x):
            yield "{0" + x[1:]
        else:
            yield x


def anchored(pattern: str) -> bool:
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]])*\]", "", re.sub(r"\\[^Az]", "", pattern))
    return any(x in bare for x in ("^", "$", "\\A", "\\z"))


def java_regex(pattern: str, options: Options) -> str:
    """Under `(?d)` a newline alone ends a line; under `(?U)` classes are those of Unicode."""
    body = re.sub(r"([^\w\s])", r"\\\1", pattern) if options.literal else "".join(_translated(pattern))
    if options.word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    return ("(?diuU)" if options.ignore_case else "(?dU)") + body


def compile_patterns(spark: SparkSession, patterns: list[str], options: Options) -> list[Query]:
    """One query for each pattern; a bad pattern raises at once."""
    if not patterns:
        raise ValueError("no pattern")
    out = [Query(i, p, java_regex(p, options), tuple(query_terms(p)), not options.literal and anchored(p)) for i, p in enumerate(patterns)]
    for q in out:
        try:
            spark._jvm.java.util.regex.Pattern.compile(q.regex)
        except Exception as e:
            raise ValueError(f"bad pattern: {q.pattern}") from e
    return out


def scout_regex(queries: list[Query]) -> str:
    """One alternation over all patterns."""
    return queries[0].regex if len(queries) == 1 else "|".join(f"(?:{q.regex})" for q in queries)
