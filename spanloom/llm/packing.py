"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of token streams in the order of a hash. A window of WINDOW tokens serves every queue in turn
with its quantum, the window's tokens times the source's share; a document that begins within the quantum is served
whole, and what it takes beyond is a deficit that the source carries to later windows. Put in sums, a document that
begins C tokens into its queue is served in window floor(C / quantum), and within it at the point C / quantum; so
windows and deficits come from distributed prefix sums, across partitions, with no state in any task. A second prefix
sum over windows gives every document its place in one stream, which is cut every LENGTH tokens. What is left at the
end of the stream is cut at powers of two, so nothing is padded.

Shares are those of the sources' own tokens unless weights are given; a source without a weight keeps its own share
beside them, and all shares are divided by their sum. Null texts count as empty: their document is the
end token alone. Null sources have a queue of their own. Ties of the hash are ordered by row. Repeated rows are packed
each; an empty table gives no sequence. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bits_for, bucket_offsets, materialize, prefix_sums, source_key

LENGTH, END = 2048, 1
#: Tokens that a window deals out over the sources.
WINDOW = 64 * LENGTH


class WordTokenizer:
    """The ids of a lower-casing word BPE as the tokenizers library gives them, much faster: words are looked up.

    Words of letters and printable signs up to U+024F, where there is nothing to compose or reorder, are split here and
    merged by rank. Every other word goes through the library as it stands, and so do whole texts with special strings
    or separators that only one side takes for white space.
    """

    BEYOND = re.compile("[^\x00-\u024f]")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    HELD = 400_000

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        # A word's end is byte 255, which UTF-8 has not; ids are ranks of merges.
        ranks = {bytes(byte[c] for c in s.removesuffix("</w>")) + b"\xff" * s.endswith("</w>"): i for s, i in vocab.items() if s not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}

    def _word(self, w: str) -> bytes:
        if w.isalpha() and max(w) < "\u0250":
            ids = self.merge(w.encode() + b"\xff")
        elif w.isprintable() and max(w) < "\u0250":
            ids = [i for p in self.PARTS.findall(w) for i in self.merge(p.encode() + b"\xff")]
        else:
            ids = self.full.encode(w, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers."""
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.known) > self.HELD:
            self.known = {}
        if text.isascii() or not self.BEYOND.search(text):
            words = text.lower().split()
        else:  # lower case is left to the library where it may depend on more than the letter
            words = [w if self.BEYOND.search(w) else w.lower() for w in text.split()]
        known = self.known
        try:
            cells = b"".join(map(known.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            cells = b"".join(map(known.__getitem__, words))
        return np.frombuffer(cells, "<u4")


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, skey, key, n, ids): ids little-endian, two bytes each where the vocabulary allows, with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        kind = "<u2" if t.full.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.append(t.ids(x or ""), np.uint32(END)) for x in part.column("text").to_pylist()]
                cells = [x.astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(x) for x in ids], pa.int64()), pa.array([int(kind[2])] * len(ids), pa.int32()), pa.array(cells, pa.binary())], ["row", "id", "skey", "key", "n", "width", "ids"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, skey string, key long, n long, width int, ids binary")


def places(tokens: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, int]:
    """(row, place): where in the stream each document begins; and the stream's length."""
    plan = materialize(tokens.select("row", "skey", "key", "n"), "packing-plan")
    rows, total = plan.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Shares: the weights given, where a source has one, and its own tokens else; then all by their sum, so that they are 1 together.
    queues = materialize(plan.groupBy("skey").agg(F.sum("n").alias("queue")), "packing-queues")
    share = F.col("queue") / F.lit(float(total or 1))
    if weights:
        of = F.coalesce(*(F.when(F.col("skey") == f"s{k}", F.lit(float(v))) for k, v in weights.items() if v > 0), F.lit(None).cast("double"))
        share = F.coalesce(of / F.lit(float(sum(v for v in weights.values() if v > 0) or 1)), share)
    queues = queues.withColumn("share", share)
    whole = queues.agg(F.sum("share")).first()[0] or 1.0
    queues = queues.select("skey", (F.col("share") / F.lit(whole) * WINDOW).alias("quantum"))
    begun = prefix_sums(plan, ["skey"], "key", ["row"], "n", "begin", bits_for(rows)).join(queues, "skey")
    begun = materialize(begun.select("row", "skey", "key", "n", (F.col("begin") / F.col("quantum")).alias("time")).withColumn("window", F.floor("time")), "packing-times")
    sums = begun.groupBy("window").agg(F.sum("n").alias("tokens")).withColumn("one", F.lit(1))
    starts = bucket_offsets(sums, ["one"], "window", "tokens", "start").select("window", "start")
    # Every document has a token, and a window's documents begin within its quanta: a window has WINDOW documents at most.
    w = Window.partitionBy("window").orderBy("time", "skey", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return begun.join(starts, "window").select("row", (F.col("start") + F.col("inside")).alias("place")), total


def sequence_at(place: int, total: int) -> tuple[int, int, int]:
    """(sequence, its start, its end) over a place of the stream."""
    tail = total - total % LENGTH
    if place < tail:
        k = place // LENGTH
        return k, k * LENGTH, (k + 1) * LENGTH
    start, k, left = tail, tail // LENGTH, total - tail
    while True:
        size = 1 << left.bit_length() - 1
        if place < start + size:
            return k, start, start + size
        start, k, left = start + size, k + 1, left - size


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    tokens = materialize(tokenize(docs, path, id_col, text_col, source_col), "packing-tokens")
    where, total = places(tokens, weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picks, rows = [], []
            for i, (place, width, cell) in enumerate(zip(b.column("place").to_pylist(), b.column("width").to_pylist(), b.column("ids").to_pylist(), strict=True)):
                raw = memoryview(np.frombuffer(cell, f"<u{width}").astype("<u4").tobytes())
                n, at = len(raw) // 4, 0
                while at < n:
                    k, start, end = sequence_at(place + at, total)
                    length = min(n - at, end - place - at)
                    rows.append((at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n, k, place + at - start))
                    picks.append(i)
                    at += length
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(picks, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = tokens.schema["id"].dataType.simpleString()
    met = tokens.select("row", "id", "width", "ids").join(where, "row")
    return met.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
