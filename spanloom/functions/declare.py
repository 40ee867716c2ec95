"""Comment masking and declaration tables: the parts that need a state per file.

Text is handled as one character for each UTF-8 byte (Latin-1), so lengths and columns are those of bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import CALLABLE_WORDS, CONTROL_WORDS, KEYWORDS, MAX_FILE_BYTES, MODIFIERS, PREPROCESSOR_DIRECTIVES

A = re.ASCII
OPENERS = re.compile(r"\"\"\"|'''|\"|'|/\*|//|#")
NOT_A_COMMENT = re.compile(r"#(?:!?\[|(?:%s)(?!\w)|(?:[0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})(?!\w))" % "|".join(PREPROCESSOR_DIRECTIVES), A)
#: What closes each literal, and what shows that an open one goes on in the next line.
CLOSERS = {q: re.compile(rf"(?s:(?:\\.|[^\\{q}])*){q}") for q in "\"'"} | {q * 3: re.compile(rf"(?s:(?:\\.|(?!{q * 3})[^\\])*){q * 3}") for q in "\"'"}
GOES_ON = re.compile(r"(?s:(?:\\.|[^\\])*)\\")


class Masker:
    """Line by line, the stretches that are comments or literals."""

    def __init__(self) -> None:
        self.open = ""

    def _close(self, line: str, at: int) -> int:
        """Where the open literal or comment ends; the line's end if it does not."""
        if self.open == "/*":
            end = line.find("*/", at)
            if end >= 0:
                self.open = ""
                return end + 2
            return len(line)
        if m := CLOSERS[self.open].match(line, at):
            self.open = ""
            return m.end()
        if len(self.open) == 1 and not GOES_ON.fullmatch(line, at):
            self.open = ""
        return len(line)

    def stretches(self, line: str) -> list[tuple[int, int, bool]]:
        """(start, end, is a comment) of each."""
        out, at = [], 0
        if self.open:
            comment = self.open == "/*"
            at = self._close(line, 0)
            out.append((0, at, comment))
        while m := OPENERS.search(line, at):
            mark = m[0]
            if mark == "#" and NOT_A_COMMENT.match(line, m.start()):
                at = m.end()
            elif mark in ("#", "//"):
                out.append((m.start(), len(line), True))
                break
            else:
                self.open = mark
                at = self._close(line, m.end())
                out.append((m.start(), at, mark == "/*"))
        return out

    def render(self, line: str) -> tuple[str, str]:
        """The line's code alone and its comments alone, all else blank."""
        code, notes, at = [], [], 0
        for start, end, comment in self.stretches(line):
            code += [line[at:start], " " * (end - start)]
            notes += [" " * (start - at), line[start:end] if comment else " " * (end - start)]
            at = end
        return "".join(code) + line[at:], "".join(notes) + " " * (len(line) - at)


def balanced(line: str, at: int, opening: str, closing: str) -> int | None:
    """Past the bracket that closes the one at `at`; in angles, arrows don't count."""
    depth = 0
    for i in range(at, len(line)):
        c = line[i]
        if c == opening:
            depth += 1
        elif c == closing and not (c == ">" and i and line[i - 1] in "-="):
            depth -= 1
            if not depth:
                return i + 1
    return None


WORD = re.compile(r"[ \t]*(\w+)", A)
NAME = re.compile(r"[A-Za-z_]\w*", A)
RECEIVER = re.compile(r"[ \t]*(func|fn)[ \t]*(?=\()", A)
BEFORE_PAREN = re.compile(r"(\w*)[ \t]*\Z", A)
SIGNATURE_PREFIX, SIGNATURE_TAIL, ASSIGNED_PREFIX = (re.compile(rf"[\w {x}]*", A) for x in (r"\t*&:<>,\[\]~", r"\t*&:<>,\[\]?\-.", r"\t.:\[\]*&@$"))
BINDING = re.compile(r"(?<![=!<>+\-*/%&|^])=(?!=)")


def _plain(text: str, allowed: re.Pattern) -> bool:
    return allowed.fullmatch(text) is not None and CONTROL_WORDS.isdisjoint(re.findall(r"\w+", text, A))


def keyword_shape(line: str) -> tuple[str, str, int] | None:
    """(kind, name, where the name stands): modifiers, a declaring keyword, a name."""
    words: list[tuple[str, int]] = []
    at = 0
    while len(words) < 8 and (m := WORD.match(line, at)):
        word, at = m[1], m.end()
        words.append((word, m.start(1)))
        rest = WORD.match(line, at)
        gap = re.compile(r"[ \t]*").match(line, at).end()
        if word in MODIFIERS and line[gap : gap + 1] == "(":
            at = balanced(line, gap, "(", ")") or at
        elif word in KEYWORDS and line[gap : gap + 1] == "<":
            at = balanced(line, gap, "<", ">") or at
        elif rest is None:
            break
    leading = 0
    while leading < len(words) and words[leading][0] in MODIFIERS:
        leading += 1
    for split in range(min(leading, len(words) - 2), -1, -1):
        name, where = words[split + 1]
        if words[split][0] in KEYWORDS and NAME.match(name):
            return words[split][0], name, where
    return None


def receiver_shape(line: str) -> tuple[str, str] | None:
    if (m := RECEIVER.match(line)) and (end := balanced(line, m.end(), "(", ")")) and (name := WORD.match(line, end)) and NAME.fullmatch(name[1]):
        return m[1], name[1]
    return None


def signature_shape(line: str) -> tuple[str, int] | None:
    """(name, where it stands) of a signature that opens a body on its own line."""
    if not line.rstrip().endswith("{") or (paren := line.find("(")) < 0:
        return None
    m = BEFORE_PAREN.search(line[:paren])
    name, where = m[1], m.start(1)
    if not NAME.fullmatch(name) or name in CONTROL_WORDS or name in KEYWORDS or not _plain(line[:where], SIGNATURE_PREFIX):
        return None
    end = balanced(line, paren, "(", ")")
    return (name, where) if end and _plain(line[end:].rstrip().rstrip("{"), SIGNATURE_TAIL) else None


def assignment_shape(line: str) -> str | None:
    """The name that a callable is bound to."""
    if not (eq := BINDING.search(line)):
        return None
    right = line[eq.end() :].lstrip(" \t")
    first = re.match(r"\w*", right, A)[0]
    if first not in CALLABLE_WORDS and not ("=>" in right and (right[:1] == "(" or first)):
        return None
    m = BEFORE_PAREN.search(line[: eq.start()])
    ok = NAME.fullmatch(m[1]) and m[1] not in CONTROL_WORDS and _plain(line[: m.start(1)], ASSIGNED_PREFIX)
    return m[1] if ok else None


def scan_declaration(line: str) -> tuple[str, str] | None:
    """(kind, name) that a masked line declares."""
    keyword = keyword_shape(line)
    if keyword is None and (receiver := receiver_shape(line)):
        return receiver
    signature = signature_shape(line)
    if signature and not (keyword and (signature[0] == keyword[1] or signature[1] < keyword[2])):
        return "function", signature[0]
    if keyword:
        return keyword[:2]
    name = assignment_shape(line)
    return ("function", name) if name else None


def declares(line: str) -> str | None:
    """The name a raw line declares; an `impl` declares none."""
    found = scan_declaration(line)
    return found[1] if found and found[0] != "impl" else None


CLOSES = re.compile(r"[ \t]*(?:end|[)\]};,]+)[ \t]*")


@dataclass
class Declaration:
    name: str
    kind: str
    start_line: int
    end_line: int
    depth: int


def split_lines(text: str) -> list[str]:
    """Lines without their ends: a newline, with one carriage return before it; a final one makes no line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def body_ends(filled: list[tuple[int, int, bool]]) -> list[int]:
    """For each line that isn't blank, (number, indent, closes a body), the last line of a body that it would open.

    That body stops at the next such line that is indented no further. A line that does nothing but close belongs to it.
    """
    out, after = [0] * len(filled), [len(filled)] * len(filled)
    for i in range(len(filled) - 1, -1, -1):
        k = i + 1
        while k < len(filled) and filled[k][1] > filled[i][1]:
            k = after[k]
        after[i] = k
        out[i] = filled[-1][0] if k == len(filled) else filled[k][0] if filled[k][2] else filled[k - 1][0]
    return out


def nesting(indents: list[int]) -> list[int]:
    """The depth of each declaration: one more than that of the nearest earlier one that is indented less."""
    depth, outer = [], []
    for i, own in enumerate(indents):
        k = i - 1
        while k >= 0 and indents[k] >= own:
            k = outer[k]
        outer.append(k)
        depth.append(0 if k < 0 else depth[k] + 1)
    return depth


def declaration_table(code: list[str]) -> list[Declaration]:
    """The declarations of masked lines. One that holds others ends before the first of these."""
    bare = [(n, x, x.lstrip(" \t")) for n, x in enumerate(code, 1)]
    filled = [(n, len(x) - len(rest), CLOSES.fullmatch(x) is not None) for n, x, rest in bare if rest]
    found = [(i, scan_declaration(code[n - 1])) for i, (n, _, _) in enumerate(filled)]
    found = [(i, *d) for i, d in found if d]
    ends, depth = body_ends(filled), nesting([filled[i][1] for i, _, _ in found])
    starts = [filled[i][0] for i, _, _ in found]
    limits = [s - 1 for s in [*starts, len(code) + 1][1:]][: len(found)]
    return [Declaration(name, kind, start, max(start, min(ends[i], limit)), d) for (i, kind, name), start, limit, d in zip(found, starts, limits, depth, strict=True)]


def analyze(content: str) -> tuple[list[Declaration], list[str], list[str]]:
    """A file's declarations, code lines and comment lines (as Latin-1)."""
    raw, masker = content.encode("utf-8", "surrogatepass"), Masker()
    shown = [masker.render(line) for line in split_lines(raw.decode("latin-1"))]
    code = [c for c, _ in shown]
    return (declaration_table(code) if len(raw) <= MAX_FILE_BYTES else []), code, [n for _, n in shown]


DECLS = "array<struct<name:string,kind:string,start_line:bigint,end_line:bigint,depth:int>>"


def _tables(contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [vars(d) for d in analyze(c)[0]] for c in contents], dtype=object)


def _comments(contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [x.encode("latin-1").decode("utf-8", "replace") for x in analyze(c)[2]] for c in contents], dtype=object)


def _codes(contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [x.encode("latin-1").decode("utf-8", "replace") for x in analyze(c)[1]] for c in contents], dtype=object)


def _names(lines: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [declares(y) for y in x] for x in lines], dtype=object)


def declarations(content: Column | str) -> Column:
    return F.pandas_udf(_tables, DECLS)(content)


def comment_lines(content: Column | str) -> Column:
    return F.pandas_udf(_comments, "array<string>")(content)


def code_lines(content: Column | str) -> Column:
    return F.pandas_udf(_codes, "array<string>")(content)


def declared_names(lines: Column) -> Column:
    """The name that each raw line of an array declares."""
    return F.pandas_udf(_names, "array<string>")(lines)


def with_declarations(files: DataFrame) -> DataFrame:
    """files with a column decls: each file's declaration table, by start line."""
    return files.withColumn("decls", declarations("content"))

