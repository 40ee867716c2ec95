"""Media columns by signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass over the stored bytes. A validator of
the format then walks its structure and tells its exact length, or refuses. What stands at offset 0 gives the actual
type, whatever the declared type says; valid media at other offsets are carved.

Media may stand within others; each is found by itself, and carve() cuts its bytes out. A validator's cost doesn't grow
with the number of magic bytes, but for PNG's checksums and gzip streams, which are read from each place they begin at.

Null bytes are of unknown type with nothing to carve. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

UNKNOWN = "application/octet-stream"
#: Samples in a row of the stored images; payloads are multiples of it.
ROW = 576


class Blob:
    """Bytes with what several validators ask of them, found once: places of marks, and walks that lead to the same place.

    A walk goes from place to place by what stands there, so two that meet go on together. What one found out holds for
    all that come to a place it passed, and a blob full of magic bytes costs no more than one walk through it.
    """

    def __init__(self, data: bytes):
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self._known: dict[tuple, int | None] = {}
        self._chains: list[tuple[set[int], int | None, int]] = []
        self._chain_of: dict[int, int] = {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at` on; -1 for none."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        places = self._marks[mark]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def next_jpeg_marker(self, at: int) -> int:
        """The first marker from `at` on that isn't part of coded data."""
        if b"jpeg" not in self._marks:
            x = np.frombuffer(self.data, np.uint8)
            self._marks[b"jpeg"] = np.flatnonzero((x[:-1] == 255) & (x[1:] != 0) & ((x[1:] < 0xD0) | (x[1:] > 0xD7))).tolist()
        places = self._marks[b"jpeg"]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def walk(self, kind: str, state: object, step: Callable[[object], tuple[object, int | None, bool]]) -> int | None:
        """Where a walk ends, None if nowhere. step(state): the next state, or the end found, and whether it is over."""
        passed = []
        while (kind, state) not in self._known:
            passed.append(state)
            state, end, over = step(state)
            if over:
                break
        else:
            end = self._known[kind, state]
        self._known.update({(kind, x): end for x in passed})
        return end

    def on_chain(self, start: int, end: int, after: Callable[[int], int]) -> bool:
        """Whether the chain of places from start passes end."""
        if start not in self._chain_of:
            own, i = set(), start
            while i < len(self.data) and i not in self._chain_of and i not in own:
                own.add(i)
                i = after(i)
            met = self._chain_of.get(i)
            self._chains.append((own | {i}, met, i))
            self._chain_of.update(dict.fromkeys(own, len(self._chains) - 1))
        chain, at = self._chain_of[start], start
        while True:
            own, parent, meets = self._chains[chain]
            if end in own and end >= at:
                return True
            if parent is None or end < meets:
                return False
            chain, at = parent, meets


def _png(b: Blob, at: int) -> int | None:
    d, i = b.data, at + 8
    while i + 12 <= len(d):
        (n,), kind = struct.unpack_from(">I", d, i), d[i + 4 : i + 8]
        first = i == at + 8
        if i + 12 + n > len(d) or first != (kind == b"IHDR") or first and n != 13 or not kind.isalpha():
            return None
        if zlib.crc32(memoryview(d)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return None
        i += 12 + n
        if kind == b"IEND":
            return i - at
    return None


def _jpeg(b: Blob, at: int) -> int | None:
    d = b.data

    def step(state: tuple[int, bool]) -> tuple[tuple[int, bool], int | None, bool]:
        i, framed = state
        if i + 4 > len(d) or d[i] != 0xFF:
            return state, None, True
        mark, (n,) = d[i + 1], struct.unpack_from(">H", d, i + 2)
        if mark in (0x00, 0xFF, 0xD8, 0xD9) or n < 2:
            return state, None, True
        framed |= mark in (0xC0, 0xC1, 0xC2)
        i += 2 + n
        if mark == 0xDA:  # coded data up to the next marker
            if not framed or (i := b.next_jpeg_marker(i)) < 0:
                return state, None, True
            if d[i + 1] == 0xD9:
                return state, i + 2, True
        return (i, framed), None, False

    end = b.walk("jpeg", (at + 2, False), step)
    return None if end is None else end - at


def _gif(b: Blob, at: int) -> int | None:
    d = b.data
    if len(d) < at + 13:
        return None

    def block(i: int) -> tuple[int, int | None, bool]:
        return (i, i + 1, True) if i >= len(d) or not d[i] else (i + 1 + d[i], None, False)

    def step(i: int) -> tuple[int, int | None, bool]:
        if i >= len(d):
            return i, None, True
        if d[i] == 0x3B:
            return i, i + 1, True
        if d[i] == 0x21:
            return b.walk("gif block", i + 2, block), None, False
        if d[i] == 0x2C and i + 10 < len(d):
            return b.walk("gif block", i + 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0), block), None, False
        return i, None, True

    end = b.walk("gif", at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0), step)
    return None if end is None else end - at


def _bmp(b: Blob, at: int) -> int | None:
    d = b.data
    if len(d) < at + 54:
        return None
    size, reserved, start, head, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", d, at + 2)
    if reserved or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or packing not in (0, 3) or width <= 0 or not height:
        return None
    return size if start + (width * bits + 31) // 32 * 4 * abs(height) <= size <= len(d) - at else None


def _riff(b: Blob, at: int) -> int | None:
    d = b.data
    if len(d) < at + 12 or d[at + 8 : at + 12] not in RIFF_TYPES:
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    after = lambda i: i + 8 + (struct.unpack_from("<I", d, i + 4)[0] + 1) // 2 * 2 if i + 8 <= len(d) else len(d) + 8
    return end - at if at + 20 <= end <= len(d) and b.on_chain(at + 12, end, after) else None


def _gzip(b: Blob, at: int) -> int | None:
    d = b.data
    try:
        inner, chunk = zlib.decompressobj(31), memoryview(d)[at:]
        while not inner.eof and len(chunk):
            inner.decompress(chunk, 1 << 20)
            chunk = inner.unconsumed_tail
        return len(d) - at - len(inner.unused_data) if inner.eof else None
    except zlib.error:
        return None


def _zip(b: Blob, at: int) -> int | None:
    d, end = b.data, b.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    return end + 22 + note - at if at + start + size == end and d[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(d) else None


def _pdf(b: Blob, at: int) -> int | None:
    end = b.next(b"%%EOF", at)
    return end + 5 - at if end > 0 and 0 <= b.next(b"startxref", at) <= end - 9 else None


RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
#: The formats' magic bytes, media types and validators.
FORMATS: tuple[tuple[bytes, str, Callable[[Blob, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)


@dataclass
class Sniffed:
    actual: str = UNKNOWN
    length: int = 0
    corrected: bool = False
    carved: list[tuple[int, int, str]] = field(default_factory=list)


_automaton = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            _automaton.add_word(magic.decode("latin-1"), k)
        _automaton.make_automaton()
    return _automaton


def sniff(data: bytes | None, declared: str | None = None) -> Sniffed:
    """The type and length of what stands at offset 0, and (offset, length, type) of media elsewhere: inside it, or after it."""
    out, blob = Sniffed(), Blob(data or b"")
    for last, k in automaton().iter((data or b"").decode("latin-1")):
        magic, kind, valid = FORMATS[k]
        at = last + 1 - len(magic)
        if (n := valid(blob, at)) is None:
            continue
        kind = RIFF_TYPES[data[at + 8 : at + 12]] if magic == b"RIFF" else kind
        if at == 0:
            out.actual, out.length = kind, n
        else:
            out.carved.append((at, n, kind))
    out.corrected = declared != out.actual
    return out


def encode(payload: bytes, kind: str) -> bytes:
    """payload (a positive multiple of ROW bytes) as lossless 8-bit samples."""
    rows = len(payload) // ROW
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    if kind == "image/bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + len(payload), 0, 1078, 40, ROW, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + payload
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(media: bytes, kind: str) -> bytes:
    """The samples of media that encode() made, of the type that sniff() found."""
    if kind == "audio/wav":
        return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind != "image/png":
        raise ValueError(f"no 8-bit samples in {kind}")
    rows, i, body = struct.unpack_from(">I", media, 20)[0], 8, []
    while i < len(media):
        n = struct.unpack_from(">I", media, i)[0]
        if media[i + 4 : i + 8] == b"IDAT":
            body.append(media[i + 8 : i + 8 + n])
        i += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


KINDS = ("audio/wav", "image/bmp", "image/png")
#: Bytes of media in a batch that goes on to Spark or is read back.
BATCH = 16 << 20


def _stored(batches: Iterator[pa.RecordBatch], declared: str) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, declared, media) of batches (id, text), in batches of bounded bytes."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array([declared] * len(ids), pa.string()), pa.array(media, pa.binary())], ["id", "n_bytes", "declared", "media"])

    for batch in batches:
        rows, held, id_type = [], 0, batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            payload = raw + b"\xff" * (-len(raw) % ROW if raw else ROW)
            rows.append((key, len(raw), encode(payload, KINDS[hashlib.sha256(payload).digest()[0] % 3])))
            held += len(rows[-1][2])
            if held > BATCH:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, text) of docs, and the type of id."""
    kept = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept, kept.schema["id"].dataType.simpleString()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "image/png") -> DataFrame:
    """A media column from texts: (id, n_bytes, declared, media). The payload's digest picks the format, so that the declared type is wrong for some."""
    kept, kind = _texts(docs, id_col, text_col)
    return kept.mapInArrow(lambda batches: _stored(batches, declared), f"id {kind}, n_bytes long, declared string, media binary").withColumnRenamed("id", id_col)


def sniff_column(df: DataFrame, id_col: str, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """General form: (id, actual, length, corrected, carved) of any binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(m, d) for m, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            carved = pa.array([[{"offset": a, "length": n, "type": t} for a, n, t in x.carved] for x in found], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))
            cols = [pa.array([getattr(x, c) for x in found], t) for c, t in (("actual", pa.string()), ("length", pa.int64()), ("corrected", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, carved], ["id", "actual", "length", "corrected", "carved"])

    kept = bounded(df).select(F.col(id_col).alias("id"), media_col, declared_col)
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, actual string, length long, corrected boolean, carved array<struct<offset:long,length:long,type:string>>").withColumnRenamed("id", id_col)


def carve(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, offset, length, type, sha256, media): the bytes of all valid media that stand within or after others, a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                found = sniff(data).carved
                for k in range(0, len(found), 64):
                    part = found[k : k + 64]
                    cut = [data[a : a + n] for a, n, _ in part]
                    ids = batch.column(0).take(pa.array([i] * len(part), pa.int64()))
                    places = [pa.array(x) for x in zip(*part, strict=True)]
                    digests = pa.array([hashlib.sha256(c).hexdigest() for c in cut])
                    yield pa.RecordBatch.from_arrays([ids, *places, digests, pa.array(cut, pa.binary())], ["id", "offset", "length", "type", "sha256", "media"])

    kept = bounded(df).select(F.col(id_col).alias("id"), media_col)
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, offset long, length long, type string, sha256 string, media binary").withColumnRenamed("id", id_col)


TOLD = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, *TOLD) of batches (id, n_bytes, declared, media)."""
    for batch in batches:
        out = []
        for declared, media in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = sniff(media, declared)
            payload = decode(media[: x.length], x.actual)
            samples = np.frombuffer(payload, np.uint8)
            feature = f"{x.actual};samples={len(samples)};mean={samples.mean():.4f};max={samples.max()};corrected={int(x.corrected)};embedded={len(x.carved)}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        told = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names)


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digests and features of a stored media column: the bytes are sniffed, carved to the length found, and decoded by the type found."""
    kept = bounded(stored).select(F.col(id_col).alias("id"), "n_bytes", "declared", "media")
    return kept.mapInArrow(_told, f"id {kept.schema['id'].dataType.simpleString()}, {TOLD}").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "image/png") -> DataFrame:
    """read_back(store_texts(docs)) in one Python stage: the media column's batches are read where they were made.

    Nothing of the media goes through the JVM, a task has one worker, not two, and this holds the media of few rows at once.
    """
    kept, kind = _texts(docs, id_col, text_col)
    return kept.mapInArrow(lambda batches: _told(_stored(slices(batches), declared)), f"id {kind}, {TOLD}").withColumnRenamed("id", id_col)
