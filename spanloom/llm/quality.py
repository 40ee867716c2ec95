"""Quality classifier by co-training.

Two views of a document: its text as hashed byte pairs, and metadata of its page (length, language, source, layout of
its lines). A logistic model of each view starts from the labelled rows; over ROUNDS rounds each gives the other the
unlabelled rows that it is surest of as pseudo-labels. Both are calibrated on labelled rows left out of the fit, and
every document is scored by the two calibrated views together.

The models are fitted on a bounded sample: at most LABELLED labelled and UNLABELLED other rows, chosen by the hash of
their id; one executor task fits on it. All documents are scored, whole. A null or empty text scores 0. Rows with null
ids can't be labelled but are scored. Repeated labels of an id count once, by their mean; of rows that share an id one is
learned from. Without labels of both classes every text that has a word scores 1. Extra columns are ignored by
score_quality.
"""

from __future__ import annotations

import operator
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import bounded, matrix, slices

LABELLED, UNLABELLED, ROUNDS = 6000, 4000, 4
#: Pseudo-labels of each class that a view may give in a round.
GIVEN = 200
THRESHOLD = 0.5
META = 42
HAS_WORD = re.compile(r"[^\W\d_]")


def page_features(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata and layout: nothing here depends on which words stand where."""
    out = np.zeros(META, np.float32)
    n = len(text) if n_chars is None else n_chars
    lines, words = text.split("\n"), text.split()
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = lambda mask: float(mask.mean()) if len(raw) else 0.0
    out[:12] = (
        np.log1p(max(0, n)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(len(text) / len(lines)) / 8,
        len(set(lines)) / len(lines),
        share((raw >= 65) & (raw <= 90)),
        share((raw >= 48) & (raw <= 57)),
        share(raw == 32),
        share((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 122) & (raw < 127)),
        share(raw >= 128),
        n < 200,
        len(set(words)) / max(1, len(words)),
        sum(map(operator.eq, words, words[1:])) / max(1, len(words)),
    )
    out[12 + np.frombuffer((lang or "").encode()[:2].ljust(2), np.uint8).sum() % 10] = 1
    out[22 + sum((source or "").encode()) % 20] = 0.3
    return out


@dataclass
class CoTrained:
    """The views' models (text, page) with their calibrations; none if there was nothing to learn from."""

    text: np.ndarray | None = None
    page: np.ndarray | None = None
    text_scale: tuple[float, float] = (1.0, 0.0)
    page_scale: tuple[float, float] = (1.0, 0.0)
    #: Log odds of the good class among labelled rows.
    prior: float = 0.0

    def probabilities(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, the page view, and both: as views that are independent given the class, so the prior counts once."""
        a = self.text_scale[0] * linear.margin(x, self.text) + self.text_scale[1]
        b = self.page_scale[0] * linear.margin(z, self.page) + self.page_scale[1]
        return linear.sigmoid(a), linear.sigmoid(b), linear.sigmoid(a + b - self.prior)


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    """x, z: the rows' views; y: their classes, -1 for rows without a label. Rows are never copied: each view's model gets classes and weights."""
    own = np.flatnonzero(y >= 0)
    held = own[3::4]
    fit = np.setdiff1d(own, held)
    if len({*y[own]}) < 2:
        return CoTrained()
    if len({*y[fit]}) < 2 or len({*y[held]}) < 2:
        fit, held = own, own
    free = np.flatnonzero(y < 0)
    rate = y[fit].mean()
    # Of each view: the classes it learns from, and which rows have one.
    classes, known = [np.zeros(len(y)) for _ in range(2)], [np.zeros(len(y)) for _ in range(2)]
    for k in range(2):
        classes[k][fit], known[k][fit] = y[fit], 1
    for k in range(rounds + 1):
        models = [linear.logistic(v, c, w) for v, c, w in zip((x, z), classes, known, strict=True)]
        if k == rounds or not len(free):
            break
        for give, view, take in ((0, x, 1), (1, z, 0)):
            m = linear.margin(view, models[give])
            order = free[np.argsort(m[free], kind="stable")]
            order = order[known[take][order] == 0]
            low, high = max(1, int(given * (1 - rate))), max(1, int(given * rate))
            good = order[-high:][m[order[-high:]] > 1]
            bad = order[:low][m[order[:low]] < -1]
            for rows, label in ((bad, 0), (good, 1)):
                classes[take][rows], known[take][rows] = label, 1
    text, page = models
    scales = [linear.platt(linear.margin(v[held], w), y[held]) for v, w in ((x, text), (z, page))]
    return CoTrained(text, page, *scales, float(np.log((y[own] == 1).sum() / (y[own] == 0).sum())))


FIELDS = ("text", "lang", "source", "n_chars")


def _views(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([linear.grams(t or "") for t, *_ in rows], np.float32).reshape(-1, linear.GRAMS)
    z = np.array([page_features(t or "", *rest) for t, *rest in rows], np.float32).reshape(-1, META)
    return x, z


def _columns(docs: DataFrame) -> list:
    return [F.col(c).cast("long" if c == "n_chars" else "string").alias(c) if c in docs.columns else F.lit(None).cast("long" if c == "n_chars" else "string").alias(c) for c in FIELDS]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> CoTrained:
    """Fitted by one task from two bounded samples of feature rows."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__sl_id")).agg(F.avg("quality").alias("y"))
    some = known.orderBy(F.xxhash64("__sl_id"), "__sl_id").limit(LABELLED)
    rows = bounded(docs).select(F.col(id_col).alias("__sl_id"), *_columns(docs))
    by_hash = (F.xxhash64("__sl_id", F.lit(1)), F.col("__sl_id"))
    others = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__sl_id")).orderBy(*by_hash).limit(LABELLED + UNLABELLED).distinct()
    others = others.join(F.broadcast(some), "__sl_id", "left_anti").orderBy(*by_hash).limit(UNLABELLED).withColumn("y", F.lit(-1.0))
    picked = rows.join(F.broadcast(some.unionByName(others)), "__sl_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, z = _views(list(zip(*(b.column(c).to_pylist() for c in FIELDS), strict=True)))
            both = np.hstack([x, z]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("__sl_id"), b.column("y"), pa.array([r.tobytes() for r in both], pa.binary())], ["id", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, f = [], [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            y += b.column("y").to_pylist()
            f.append(matrix(b.column("f"), np.float16).copy())
        y = np.array([-1.0 if v < 0 else float(v >= 0.5) for v in y])
        x, z, place = np.empty((len(ids), linear.GRAMS), np.float32), np.empty((len(ids), META), np.float32), np.empty(len(ids), np.int64)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
        place[order] = np.arange(len(ids))
        at = 0
        for part in f:
            x[place[at : at + len(part)]], z[place[at : at + len(part)]] = part[:, : linear.GRAMS], part[:, linear.GRAMS :]
            at += len(part)
        del f
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(co_train(x, z, y[order]) if len(y) else CoTrained())], pa.binary())], ["model"])

    kind = rows.schema["__sl_id"].dataType.simpleString()
    # One row for each id, so that an id which many rows share counts once. The sample is bounded and one task fits on it, so that the driver sees the model alone.
    learned = picked.select("__sl_id", "y", *FIELDS).mapInArrow(features, f"id {kind}, y double, f binary").groupBy("id", "y").agg(F.min("f").alias("f"))
    got = learned.repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(got["model"]) if got else CoTrained()


def score_rows(model: CoTrained, rows: list[tuple]) -> np.ndarray:
    """(text score, page score, score) of each row."""
    if not rows:
        return np.zeros((0, 3))
    if model.text is None:
        wordy = np.array([bool(t and HAS_WORD.search(t)) for t, *_ in rows])
        return np.repeat(wordy[:, None].astype(float), 3, axis=1)
    return np.stack(model.probabilities(*_views(rows)), axis=1) * np.array([bool(t) for t, *_ in rows])[:, None]


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """(id, text_score, page_score, score, quality) of every document; quality is 1 from THRESHOLD on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.vstack([np.zeros((0, 3)), *(score_rows(model, list(zip(*(b.column(c).slice(i, 512).to_pylist() for c in FIELDS), strict=True))) for i in range(0, b.num_rows, 512))])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, k].astype(np.float64)) for k in range(3)), pa.array((s[:, 2] >= THRESHOLD).astype(np.int32))], ["id", "text_score", "page_score", "score", "quality"])

    rows = bounded(docs).select(F.col(id_col).alias("id"), *_columns(docs))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_score double, page_score double, score double, quality int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    at = [docs.columns.index(c) if c in docs.columns else None for c in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [score_rows(model, list(zip(*([None] * p.num_rows if i is None else p.column(i).to_pylist() for i in at), strict=True)))[:, 2] >= THRESHOLD for p in (b.slice(i, 512) for i in range(0, b.num_rows, 512))]
            yield b.filter(pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
