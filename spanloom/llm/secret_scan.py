"""Secret scans by a recursive decoding worklist.

Each text is scanned, then every URL-escaped, Unicode-escaped, base64 or compressed part of it is unwrapped into a
layer of its own, which is scanned and unwrapped in turn until nothing new appears. A layer knows where each of its
characters came from, so all spans are code points of the original text (end exclusive). A layer that was seen before
at the same place ends the descent (cycle detection).

Escapes within escapes are scanned layer by layer LEVELS deep; a text that is escaped deeper has its escapes undone to
the end in one pass, so that the cost doesn't grow with the square of a text that escapes its own escape signs.

Nulls and empty texts have no spans. Rows are independent: repeated rows give repeated results. Extra columns are
ignored by scan_secrets and kept by redact_secrets.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|&\#[^;]+;")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run of base64 lines joined by line ends with or without an indent, and a short first line before it.
LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:\r\n|\n|\r)[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
SHORT = re.compile(r"[A-Za-z0-9+/_-]{1,15}(?:\r\n|\n|\r)[\x20\t]*\Z")
SEPARATOR = re.compile(r"[+/_-]")
PLAIN64 = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
#: Inflated layers are scanned in chunks of so many bytes, of which the next repeats OVERLAP at least; decoders give PIECE at once.
CHUNK, OVERLAP, PIECE = 16 << 20, 1 << 20, 1 << 20
CONTROL = bytes([*range(9), *range(14, 28), 127])
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
#: Streams packed into each other without base64 between; only one that unpacks to itself goes so deep.
DEEPEST = 100
#: Layers of escapes within escapes that are scanned one by one; what is escaped deeper is unescaped to its end at once.
LEVELS = 8
#: An escape at the end of a text.
TAIL = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};)\Z")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost non-overlapping matches of each kind, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; parts: (start here, start above, end above, verbatim) by start, over the layer above; level: how many layers of escapes it came through."""

    def __init__(self, text: str, parts: list[tuple[int, int, int, bool]] | None = None, above: Layer | None = None, level: int = 0):
        self.text, self.parts, self.above, self.level = text, parts, above, level
        self.starts = [p[0] for p in parts or []]

    def root_span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parts is not None:
            first = layer.parts[bisect.bisect_right(layer.starts, start) - 1]
            last = layer.parts[bisect.bisect_right(layer.starts, end - 1) - 1]
            start = first[1] + (start - first[0]) * first[3]
            end = last[1] + end - last[0] if last[3] else last[2]
            layer = layer.above
        return start, end


def _replaced(above: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer's text with [start, end) of each piece replaced."""
    out, parts, at, n = [], [], 0, 0
    for start, end, new in pieces:
        if start > at:
            parts.append((n, at, start, True))
            out.append(above.text[at:start])
            n += start - at
        if new:
            parts.append((n, start, end, False))
            out.append(new)
            n += len(new)
        at = end
    if at < len(above.text):
        parts.append((n, at, len(above.text), True))
        out.append(above.text[at:])
    return Layer("".join(out), parts, above, above.level + 1)


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in PERCENT.finditer(layer.text):
        # A byte that isn't UTF-8 is a character by itself.
        text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        at = m.start()
        for c in text:
            alone = "\udc80" <= c <= "\udcff"
            pieces.append((at, at := at + (3 if alone else 3 * len(c.encode())), chr(ord(c) - 0xDC00) if alone else c))
    if pieces:
        yield _replaced(layer, pieces)
    if any(c == "\0" for _, _, c in pieces):  # UTF-16
        yield _replaced(layer, [(start, end, c.strip("\0")) for start, end, c in pieces])


def _escaped(escape: str) -> str:
    """The character that an escape stands for; none for what is no character."""
    if escape[0] == "&":
        return html.unescape(escape)
    c = "".join(chr(v) for x in re.findall(r"[0-9A-Fa-f]+", escape) if (v := int(x, 16)) < 0x110000)
    return c.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    pieces = []
    for run in ESCAPE.finditer(layer.text):
        pieces += [(m.start(), m.end(), _escaped(m[0])) for m in ONE_ESCAPE.finditer(layer.text, run.start(), run.end())]
    if pieces:
        yield _replaced(layer, pieces)


def _unescaped(layer: Layer) -> Iterator[Layer]:
    """All escapes undone in one pass, those too that undoing others makes: characters go onto a stack, and an escape at its top is replaced by its character at once."""
    text, chars, spans, at = layer.text, [], [], 0
    if not any(sign in text for sign in ("%", "\\", "&#")):
        return

    def reduce() -> None:
        while chars and chars[-1] in "0123456789abcdefABCDEF;}":
            if not (m := TAIL.search("".join(chars[-12:]))):
                return
            n = len(m[0])
            # One byte of several, or of none: decoded with its neighbours below.
            c = chr(v if (v := int(m[0][1:], 16)) < 128 else 0xDC00 + v) if m[0][0] == "%" else _escaped(m[0])
            start, end = spans[-n][0], spans[-1][1]
            del chars[-n:], spans[-n:]
            if not c:
                return
            chars.append(c)
            spans.append((start, end))

    for m in re.finditer(r"[0-9A-Fa-f;}]", text):
        for i in range(at, m.end()):
            chars.append(text[i])
            spans.append((i, i + 1))
        at = m.end()
        reduce()
    for i in range(at, len(text)):
        chars.append(text[i])
        spans.append((i, i + 1))
    if len(chars) == len(text):
        return
    out, parts, n, i = [], [], 0, 0
    while i < len(chars):
        k = i + 1
        if "\udc80" <= chars[i] <= "\udcff":
            while k < len(chars) and "\udc80" <= chars[k] <= "\udcff":
                k += 1
            i0, raw = i, "".join(chars[i:k]).encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")
            for c in raw:
                alone = "\udc80" <= c <= "\udcff"
                width = 1 if alone else len(c.encode())
                parts.append((n, spans[i0][0], spans[i0 + width - 1][1], False))
                out.append(chr(ord(c) - 0xDC00) if alone else c)
                n, i0 = n + 1, i0 + width
        else:
            parts.append((n, *spans[i], False))
            out.append(chars[i])
            n += len(chars[i])
        i = k
    yield Layer("".join(out), parts, layer, layer.level + 1)


def _decoder(head: bytes) -> tuple[object, int | None] | None:
    """A decoder of the format that head begins, and how much input it may be given at once where its output can't be limited."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31), None
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(), None
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), None
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), None
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj(), 512
    return None


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """All members, streams or frames of a compressed stream, decoded one after another, and what follows them as it is."""
    data = b""
    while True:
        while len(data) < 6 and (more := next(pieces, None)) is not None:
            data += more
        if not data:
            return
        if (found := _decoder(data)) is None:
            yield data
            yield from pieces
            return
        decoder, most = found
        raw, n = [data], len(data)
        try:
            while not decoder.eof:
                if not data:
                    data = next(pieces, b"")
                    raw, n = raw + [data] if n < CHUNK else raw, n + len(data)
                if not data:
                    if isinstance(decoder, type(zlib.decompressobj())):
                        yield decoder.flush()
                    raise EOFError
                if most:
                    out, data = decoder.decompress(data[:most]), data[most:]
                    data = (decoder.unused_data + data) if decoder.eof else data
                elif isinstance(decoder, type(zlib.decompressobj())):
                    out = decoder.decompress(data, PIECE)
                    data = decoder.unused_data if decoder.eof else decoder.unconsumed_tail
                else:
                    out, data = decoder.decompress(data, PIECE), b""
                    while not decoder.eof and not decoder.needs_input:
                        yield out
                        out = decoder.decompress(b"", PIECE)
                    data = decoder.unused_data if decoder.eof else b""
                if out:
                    yield out
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            # Damaged, or text that only begins like a compressed stream.
            yield from raw
            yield from pieces
            return


def _inflated(pieces: Iterator[bytes], depth: int = 0) -> Iterator[bytes]:
    """The stream, unpacked as often as it begins as a compressed one."""
    head = b""
    while len(head) < 6 and (more := next(pieces, None)) is not None:
        head += more
    again = itertools.chain([head] if head else [], pieces)
    if depth == DEEPEST or _decoder(head) is None:
        yield from again
    else:
        yield from _inflated(_members(again), depth + 1)


def _chunks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The stream to its end in chunks; each begins with the end of the one before, back to where its last base64 run begins."""
    held, new, n = b"", [], 0
    for piece in pieces:
        new.append(piece)
        n += len(piece)
        if n >= CHUNK:
            held = b"".join([held, *new])
            yield held
            cut = min(len(held.rstrip(RUN)), len(held) - OVERLAP)
            held, new, n = held[max(0, cut, len(held) - CHUNK) :], [], 0
    if n:
        yield b"".join([held, *new])


def _texts(data: bytes) -> Iterator[tuple[str, bool]]:
    """Every reading of the bytes, and whether it is clean: UTF-8, or UTF-16 by its mark; else each byte a character, and where bytes are zero, one without those, as of UTF-16."""
    text = None
    try:
        text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError:
        pass
    yield (data.decode("latin-1"), False) if text is None else (text, len(data.translate(None, CONTROL)) * 10 >= len(data) * 9)
    if text is not None and data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        yield data.decode("latin-1"), False
    elif b"\0" in data:
        yield data.replace(b"\0", b"").decode("latin-1"), False


def _decoded(body: str, at: Sequence[int], layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers of base64 characters and whether each reads as a clean whole; at: the place of each in the layer above."""
    bare = body.rstrip("=").replace("-", "+").replace("_", "/")
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    data = base64.b64decode(bare + "=" * (-len(bare) % 4))
    whole = [(0, at[0], at[-1] + 1, False)]
    if _decoder(data):
        packed = False
        for chunk in _chunks(_inflated(iter([data]))):
            if chunk == data:
                break
            packed = True
            yield from ((Layer(text, whole, layer), True) for text, _ in _texts(chunk))
        if packed:
            return
    for text, clean in _texts(data):
        # A character a byte, each has its own place.
        yield Layer(text, [(i, at[i // 3 * 4], at[min(i // 3 * 4 + 4, len(at)) - 1] + 1, False) for i in range(0, len(text), 3)] if len(text) == len(data) else whole, layer), clean


def _starts(body: str, starts: Iterable[int]) -> list[int]:
    """Those of the starts (ascending) to decode from: the first of each place in a group of four, which holds what the later ones give, and every one where a compressed stream begins."""
    out, met = [], set()
    for i in starts:
        head = body[i : i + 8].replace("-", "+").replace("_", "/")
        if i % 4 not in met or len(head) == 8 and "=" not in head and _decoder(base64.b64decode(head)):
            out.append(i)
            met.add(i % 4)
    return out


def _wrapped(layer: Layer) -> Iterator[Layer]:
    """Runs over several lines as one, from each line's start and separator as far as these differ."""
    done = 0
    for run in BASE64.finditer(layer.text):
        if run.start() < done or not (m := LINES.match(layer.text, run.start())):
            continue
        done, start = m.end(), run.start()
        if short := SHORT.search(layer.text, max(0, start - 64), start):
            start = short.start()
        at = [i for i in range(start, done) if layer.text[i] not in "\r\n\t "]
        body = "".join([layer.text[i] for i in at])
        line_or_piece = [k for k in range(len(at)) if k == 0 or at[k] > at[k - 1] + 1 or body[k - 1] in "+/_-"]
        for k in _starts(body, line_or_piece):
            readable = False
            for inner, reads in _decoded(body[k:], at[k:], layer):
                readable |= reads
                yield inner
            if readable:
                break


def _base64(layer: Layer) -> Iterator[Layer]:
    for run in BASE64.finditer(layer.text):
        readable = False
        for inner, reads in _decoded(run[0], range(run.start(), run.end()), layer):
            readable |= reads
            yield inner
        if readable or run[0].isalnum():
            continue
        # Several runs glued together, or one to a prefix: each piece, and the rest from each separator.
        pieces = [(m.start(), m.end()) for m in PLAIN64.finditer(layer.text, run.start(), run.end())]
        rests = [(run.start() + i, run.end()) for i in _starts(run[0], (m.end() for m in SEPARATOR.finditer(run[0])))]
        for start, end in dict.fromkeys(pieces + rests):
            if end - start >= 2:
                yield from (inner for inner, _ in _decoded(layer.text[start:end], range(start, end), layer))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    for decode in (*((_percent, _escapes) if layer.level < LEVELS else (_unescaped,)), _base64, _wrapped):
        yield from decode(layer)


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and all of them with those that unwrapping adds."""
    base = scan(text)
    # Depth first, one layer at a time: the chunks of a bomb are never held together.
    spans, seen, todo = set(base), set(), [_unwrapped(Layer(text))]
    while todo:
        if (inner := next(todo[-1], None)) is None:
            todo.pop()
            continue
        mark = (hashlib.blake2b(inner.text.encode("utf-8", "replace"), digest_size=16).digest(), inner.root_span(0, len(inner.text)) if inner.text else None)
        if not inner.text or mark in seen:
            continue
        seen.add(mark)
        todo.append(_unwrapped(inner))
        for start, kind, end in scan(inner.text):
            lo, hi = inner.root_span(start, end)
            spans.add((lo, kind, hi))
    return base, sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the base spans' counts by kind and digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, full = find_secrets(text or "")
                for k, out in enumerate(counts):
                    out.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(full))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kept = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(text: str) -> str:
    """text with every secret, overlapping ones together, replaced by its kind in brackets."""
    out, at, joint = [], 0, []
    for start, kind, end in find_secrets(text)[1]:
        if joint and start < joint[-1][2]:
            joint[-1][2] = max(end, joint[-1][2])
        else:
            joint.append([start, kind, end])
    for start, kind, end in joint:
        out += [text[at:start], f"[{KINDS[kind]} secret]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with secrets cut out of the texts; where the table has a length column, it follows the text. Columns stay as they are otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            kind = batch.schema.field(at).type
            texts = [redacted(x) if x else x for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, kind))

    out = bounded(docs).mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
