"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes.

Features are the distinct hashed n-grams (4, 5 and 6 bytes of UTF-8, A-Z
lowered) of a text. Each is scaled by its log-count ratio
r = log((p + a) / |p|) - log((q + a) / |q|), where p and q count the toxic and
the other labelled texts that have it; a logistic regression is trained on the
scaled features. The weights are folded into one table, so that scoring adds
one number for each distinct feature of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import groups_of_texts, utf8

ORDERS = (4, 5, 6)
BITS = 20
_SLICES = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _features(part: np.ndarray, borders: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all n-grams, distinct and sorted; only ``wanted`` ones."""
    b = np.concatenate([_FOLD[part], np.full(max(ORDERS), 32, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(part), np.uint64)
    ends = borders[1:]
    found = []
    for j in range(max(ORDERS)):
        key |= b[j : len(part) + j] << np.uint64(8 * j)
        n = j + 1
        if n not in ORDERS:
            continue
        with np.errstate(over="ignore"):
            h = ((key + np.uint64(n)) * _ODD[ORDERS.index(n)]) >> np.uint64(64 - BITS)
        at = np.arange(len(part)) if wanted is None else np.flatnonzero(wanted[h.view(np.int64)])
        text = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[text] if len(at) else np.zeros(0, bool)
        found.append((text[inside] << BITS) | h[at[inside]].astype(np.int64))
    pair = np.unique(np.concatenate(found))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(column))
    for i, j in groups_of_texts(offsets):
        lo = int(offsets[i])
        yield i, j, data[lo : int(offsets[j])], offsets[i : j + 1] - lo


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> per slice of the features, how many texts of each label have them."""
    counts, texts = np.zeros((2, 1 << BITS), np.uint32), np.zeros(2, np.int64)
    for batch in batches:
        toxic = np.array(batch.column(0).to_pylist(), np.int64)
        for i, j, part, borders in _groups(batch, 1):
            texts += np.bincount(toxic[i:j], minlength=2)
            if len(part):
                text, feature = _features(part, borders)
                own = toxic[i:j][text]
                for label in (0, 1):
                    counts[label] += np.bincount(feature[own == label], minlength=1 << BITS).astype(np.uint32)
    if texts.any():
        step = (1 << BITS) // _SLICES
        for s in range(_SLICES):
            part = counts[:, s * step : (s + 1) * step]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([texts.tolist()], pa.list_(pa.int64()))], names=["slice", "counts", "texts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in table.column("counts"))
    texts = np.sum([x.as_py() for x in table.column("texts")], axis=0).tolist()
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary()), "texts": pa.array([texts], pa.list_(pa.int64()))})


@dataclass
class ToxicModel:
    """weight[number[f]] is what feature f adds; number is -1 for the others."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, part: np.ndarray, borders: np.ndarray) -> np.ndarray:
        z = np.full(len(borders) - 1, self.bias)
        if len(part) and len(self.features):
            table = np.zeros(1 << BITS)
            table[self.features] = self.weights
            text, feature = _features(part, borders, table != 0)
            z += np.bincount(text, table[feature], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def association(p: np.ndarray, q: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """The likelihood-ratio statistic of having a feature and being toxic."""
    out, n, has = np.zeros(len(p)), toxic + other, p + q
    for seen, row, column in ((p, has, toxic), (q, has, other), (toxic - p, n - has, toxic), (other - q, n - has, other)):
        expected = row * (column / n)
        out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    return 2 * out


def _train(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features scaled by r: full-batch Adam."""
    sizes = np.array([len(x) for x in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    feature = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    scale = r[feature]
    w, bias = np.zeros(len(r)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, scale * w[feature], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(feature, scale * error[owner], len(w)) / len(y) + penalty * w
        gb = error.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 + 3 * t / steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


def fit(labelled: DataFrame, sample_rows: int = 8_000, seed: int = 11, keep: int = 1 << 12, least_told: float = 13.0, penalty: float = 1e-3, steps: int = 250) -> ToxicModel:
    """Learn from ``text`` and ``toxic`` (0 or 1; other rows are left out).

    Works on a seeded sample of about ``sample_rows`` labelled rows (all, if
    there are fewer). Of all features, those are used whose likelihood ratio
    against no association with the label is at least ``least_told``, the
    ``keep`` largest, so what reaches the driver is bounded by parameters. With
    one label only, or none, the model is its bias.
    """
    rows = labelled.filter("toxic in (0, 1) and text is not null").select(labelled["toxic"].cast("int"), labelled["text"], labelled["doc_id"])
    n = rows.count()
    if n > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n) + 1)
    rows = rows.select("toxic", "text")
    found = rows.mapInArrow(_count, "slice int, counts binary, texts array<long>").groupBy("slice").applyInArrow(_add, "slice int, counts binary, texts array<long>").collect()
    if not found:
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    texts = np.array(found[0]["texts"])
    counts = np.concatenate([np.frombuffer(bytes(f["counts"]), np.uint32).reshape(2, -1) for f in sorted(found, key=lambda f: f["slice"])], axis=1).astype(float)
    prior = float(np.log((texts[1] + 1) / (texts[0] + 1)))
    if not texts.all():
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), prior)
    q, p = counts
    r = np.log((p + 1) / (texts[1] + 2)) - np.log((q + 1) / (texts[0] + 2))
    told = association(p, q, texts[1], texts[0])
    order = np.argsort(-told, kind="stable")[:keep]
    features = np.sort(order[told[order] >= least_told])
    wanted = np.zeros(1 << BITS, bool)
    wanted[features] = True

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, borders in _groups(batch, 1):
                text, feature = _features(part, borders, wanted) if len(part) else (np.zeros(0, int), np.zeros(0, int))
                lists = [x.astype(np.int32).tobytes() for x in np.split(feature, np.cumsum(np.bincount(text, minlength=j - i))[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(lists, pa.binary())], names=["toxic", "features"])

    sample = rows.mapInArrow(thin, "toxic int, features binary").collect()
    sample.sort(key=lambda s: (s["toxic"], bytes(s["features"])))
    number = np.full(1 << BITS, -1)
    number[features] = np.arange(len(features))
    vectors = [number[np.frombuffer(bytes(s["features"]), np.int32)] for s in sample]
    w, bias = _train(vectors, np.array([s["toxic"] for s in sample], float), r[features], penalty, steps)
    return ToxicModel(features, w * r[features], bias)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score for every row; only ``text`` is looked at.

    A null or empty text has no feature: its score is the bias's. Repeated rows
    are each scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.scores(part, borders) for _, _, part, borders in _groups(batch, 1)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """The contract's split: crc32 of the id as text, mod 3, is 1. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then score all rows.

    A doc_id with several labels counts as toxic if one says so; a null label
    and a null doc_id teach nothing.
    """
    known = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].alias("toxic")).filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(docs["doc_id"], docs["text"]).filter(~held_out(docs["doc_id"]))
    model = fit(texts.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"), **options)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
