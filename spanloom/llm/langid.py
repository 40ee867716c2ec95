"""Language identification by hierarchical discrimination.

A linear model over hashed byte triples predicts the language's family first. Within the family, a linear support
vector machine for each pair of languages votes; the language with most votes, then the largest summed margin, wins.
The score is the family's probability times the mean calibrated confidence of the votes that the winner took part in.

Learning: from text and non-null language of documents with crc32(id as text) mod 5 other than 0, on a bounded sample
of about PER_LANGUAGE documents a language and TOTAL in all, chosen by the hash of their id; of documents that share id
and language one is learned from. A null id is neither held out nor learned from. Texts that are null or have no letter are `und` with score 0, as all are where nothing could be
learned. All texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import bounded, matrix, slices

PER_LANGUAGE, TOTAL = 1500, 8000
#: Families by ISO 639-1 code; a language not listed is of the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tk ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt ti",
    "sinitic": "yue zh",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


@dataclass
class Hierarchy:
    langs: list[str]
    families: list[str]
    family_models: np.ndarray
    #: By family: its languages, and for each pair the model and its calibration.
    within: dict[str, tuple[list[str], list[tuple[int, int, np.ndarray, tuple[float, float]]]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs or not len(x):
            return ["und"] * len(x), np.zeros(len(x))
        if len(self.families) > 1:
            p = np.stack([linear.sigmoid(linear.margin(x, w)) for w in self.family_models], axis=1) + 1e-9
            p /= p.sum(1, keepdims=True)
        else:
            p = np.ones((len(x), 1))
        first = p.argmax(1)
        out, score = [""] * len(x), p[np.arange(len(x)), first]
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(first == f)
            langs, pairs = self.within[name]
            votes, sums, trust = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for i, j, w, (a, b) in pairs:
                m = linear.margin(x[rows], w)
                q = linear.sigmoid(a * m + b)
                for k, win, s in ((i, m > 0, 1), (j, m <= 0, -1)):
                    votes[:, k] += win
                    sums[:, k] += s * m
                    trust[:, k] += q if s > 0 else 1 - q
            best = [max(range(len(langs)), key=lambda k: (votes[r, k], sums[r, k], -k)) for r in range(len(rows))]
            for r, k in enumerate(best):
                out[rows[r]] = langs[k]
                if len(langs) > 1:
                    score[rows[r]] *= trust[r, k] / (len(langs) - 1)
        return out, np.clip(score, 0, 1)


def fit_rows(x: np.ndarray, langs: list[str]) -> Hierarchy:
    names = sorted(set(langs))
    lang = np.array(langs, object)
    fam = np.array([family(s) for s in langs], object)
    families = sorted(set(fam))
    models = []
    for f in families if len(families) > 1 else []:
        y = (fam == f).astype(float)
        models.append(linear.logistic(x, y, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()), l2=1e-5, steps=300))
    within = {}
    for f in families:
        own, pairs = [s for s in names if family(s) == f], []
        for i, j in combinations(range(len(own)), 2):
            rows = (lang == own[i]) | (lang == own[j])
            y = np.where(lang[rows] == own[i], 1.0, -1.0)
            w = linear.svm(x[rows], y)
            pairs.append((i, j, w, linear.platt(linear.margin(x[rows], w), (y > 0).astype(float))))
        within[f] = (own, pairs)
    return Hierarchy(names, families, np.array(models), within)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _features(texts: list[str]) -> np.ndarray:
    return np.array([linear.grams(t, 3, lower=True) for t in texts], np.float32).reshape(-1, linear.GRAMS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Fitted by one task on a sample of about TOTAL documents, more only if there are more languages: each has one at least."""
    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    known = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter((part != 0) & F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    # One row for each language, as in the model itself.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    if not counts:
        return Hierarchy([], [], np.zeros(0), {})
    each = max(1, min(PER_LANGUAGE, TOTAL // len(counts)))
    cuts = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"], int(each / r["n"] * (1 << 30)))) for r in counts], "lang string, cut long")
    some = known.join(F.broadcast(cuts), "lang").filter(F.col("place") <= F.col("cut"))
    some = some.select("id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cells = [linear.grams(t, 3, lower=True).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(cells, pa.binary())], ["id", "lang", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, f = [], []
        for b in batches:
            langs += b.column("lang").to_pylist()
            f.append(matrix(b.column("f"), np.float16).copy())
        x = np.concatenate([np.zeros((0, linear.GRAMS), np.float16), *f])
        # In an order that the rows alone decide.
        order = np.array(sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes())), np.int64)
        del f
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(x[order].astype(np.float32), [langs[i] for i in order]))], pa.binary())], ["model"])

    kind = known.schema["id"].dataType.simpleString()
    # One row for each id and language, so that a hot id can't fill the task.
    learned = some.mapInArrow(features, f"id {kind}, lang string, f binary").groupBy("id", "lang").agg(F.min("f").alias("f"))
    got = learned.select("lang", "f").repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(got["model"]) if got else Hierarchy([], [], np.zeros(0), {})


def identify(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, texts = [], [], b.column(2).to_pylist()
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                named = [k for k, t in enumerate(part) if has_letter(t)]
                found, score = model.predict(_features([part[k] for k in named]))
                own, value = ["und"] * len(part), [0.0] * len(part)
                for k, s, v in zip(named, found, score, strict=True):
                    own[k], value[k] = s, float(v)
                langs += own
                scores += value
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.coalesce(part == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
