"""Language identification with bit-sliced Bloom filters of n-grams.

One table of rows holds the Bloom filters of all languages side by side: a row
is a bitmask of languages, and the AND of the few rows that an n-gram hashes to
is the set of all languages that contain it, got in one step. For each text the
bits of every language are counted over its n-grams; a language's count is
corrected for the false positives that its share of set bits implies, and the
largest corrected count decides.

N-grams are four bytes of UTF-8, with A-Z lowered and everything in ASCII that
is no letter taken as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import groups_of_texts, through_arrow, utf8

N = 4
UNDETERMINED = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_HASHES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def grams(part: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte, as a number; the last N-1 wrap."""
    b = _FOLD[part].astype(np.uint32)
    b = np.concatenate([b, np.full(N - 1, 32, np.uint32)])
    out = b[: len(part)].copy()
    for j in range(1, N):
        out |= b[j : len(part) + j] << np.uint32(8 * j)
    return out


def _outside(borders: np.ndarray) -> np.ndarray:
    """Positions whose n-gram would reach into the next text."""
    ends = borders[1:]
    at = np.concatenate([np.maximum(ends - j, borders[:-1]) for j in range(1, N)]) if len(ends) else ends
    return at[at < borders[-1]] if len(borders) else at


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]


@dataclass
class LanguageFilter:
    """languages[i] owns bit i of the rows; ``rows`` has a column for every 64."""

    languages: list[str]
    rows: list[np.ndarray]
    bits: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, contents: dict[str, np.ndarray], bits: int = 21) -> LanguageFilter:
        """``contents``: the n-grams of each language."""
        languages = sorted(contents)
        rows = []
        for first in range(0, len(languages), 64):
            own = languages[first : first + 64]
            kind = next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(own) <= w)
            table = np.zeros(1 << bits, kind)
            for i, name in enumerate(own):
                for at in cls._slots(contents[name].astype(np.uint64), bits):
                    table[at] |= kind(1 << i)
            rows.append(table)
        density = np.array([((rows[i // 64] >> rows[i // 64].dtype.type(i % 64)) & 1).mean() for i in range(len(languages))])
        return cls(languages, rows, bits, density ** len(_HASHES))

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for c in _HASHES:
                yield (((keys + np.uint64(1)) * c) >> np.uint64(64 - bits)).astype(np.intp)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the bitmask of the languages that contain it."""
        out: list[np.ndarray] = []
        for at in self._slots(keys.astype(np.uint64), self.bits):
            out = [a & r[at] for a, r in zip(out, self.rows, strict=True)] if out else [r[at] for r in self.rows]
        return out

    def shares(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Texts x languages: the corrected share of a text's n-grams in a language."""
        keys = grams(data)
        masks = self.masks(keys)
        total = np.diff(borders)
        out = _outside(borders)
        total = np.maximum(total - (N - 1), 0)
        shares = np.zeros((len(borders) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[i // 64] >> masks[i // 64].dtype.type(i % 64)) & masks[i // 64].dtype.type(1)
            bit[out] = 0
            hits = _sums(bit, borders)
            rate = self.false_rate[i]
            shares[:, i] = (hits - rate * total) / np.maximum(total, 1) / max(1 - rate, 1e-9)
        return np.clip(shares, 0, 1)


def _count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, distinct n-grams, their counts), packed, per task."""
    held: dict[str, list] = {}

    def pack(lang: str, parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, counts, len(unique)).astype(np.uint32)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = utf8(batch.column(1))
        for i, j in groups_of_texts(offsets):
            lo = int(offsets[i])
            part, borders = data[lo : int(offsets[j])], offsets[i : j + 1] - lo
            if not len(part):
                continue
            keys = grams(part)
            inside = np.ones(len(part), bool)
            inside[_outside(borders)] = False
            owner = np.repeat(np.arange(j - i), np.diff(borders))
            for lang in set(langs[i:j].tolist()):
                own = inside & (langs[i:j] == lang)[owner]
                parts = held.setdefault(lang, [])
                parts.append(np.unique(keys[own], return_counts=True))
                if len(parts) > 64:
                    held[lang] = [pack(lang, parts)]
    for lang, parts in held.items():
        keys, counts = pack(lang, parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "keys", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
    unique, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts, len(unique)).astype(np.uint64)
    often = total >= 2
    return pa.table({"lang": [table.column("lang")[0].as_py()], "keys": pa.array([unique[often].tobytes()], pa.binary()), "counts": pa.array([total[often].tobytes()], pa.binary())})


def fit(labelled: DataFrame, sample_rows: int = 12_000, seed: int = 7, bits: int = 21, dominance: float = 0.1) -> LanguageFilter | None:
    """Learn from ``text`` and non-null ``lang``; None if there is nothing to learn.

    Works on a seeded sample of about ``sample_rows`` labelled rows (all, if
    there are fewer), so the model's size is bounded. A language keeps an n-gram
    that it has at least twice and whose relative frequency is at least
    ``dominance`` times that in any other language: stray foreign lines don't
    set bits.
    """
    rows = labelled.select(labelled["lang"], labelled["text"], labelled["doc_id"]).filter("lang is not null and text is not null")
    n = rows.count()
    if n > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n) + 1)
    counted = rows.select("lang", "text").mapInArrow(_count_sample, "lang string, keys binary, counts binary")
    merged = counted.groupBy("lang").applyInArrow(_merge, "lang string, keys binary, counts binary").collect()
    found = {r["lang"]: (np.frombuffer(bytes(r["keys"]), np.uint32), np.frombuffer(bytes(r["counts"]), np.uint64)) for r in merged}
    found = {k: v for k, v in found.items() if len(v[0])}
    if not found:
        return None
    every = np.unique(np.concatenate([k for k, _ in found.values()]))
    most = np.zeros(len(every))
    rates = {}
    for lang, (keys, counts) in found.items():
        rates[lang] = counts / counts.sum()
        at = np.searchsorted(every, keys)
        most[at] = np.maximum(most[at], rates[lang])
    contents = {lang: keys[rates[lang] >= dominance * most[np.searchsorted(every, keys)]] for lang, (keys, _) in found.items()}
    return LanguageFilter.build(contents, bits)


def _predict(model: LanguageFilter | None, prior: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names, scores = [], []
            for i, j in groups_of_texts(offsets):
                lo = int(offsets[i])
                part, borders = data[lo : int(offsets[j])], offsets[i : j + 1] - lo
                ascii_letters = _sums((_FOLD[part] != 32) & (part < 128), borders) if len(part) else np.zeros(j - i, int)
                if model is not None:
                    shares = model.shares(part, borders) if len(part) else np.zeros((j - i, len(model.languages)))
                for t in range(j - i):
                    if not ascii_letters[t] and not any(map(str.isalpha, part[borders[t] : borders[t + 1]].tobytes().decode())):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    elif model is None:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(shares[t].argmax())
                        names.append(model.languages[best] if shares[t, best] > 0 else prior)
                        scores.append(float(shares[t, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """doc_id, lang_pred, score for every row: only ``text`` is looked at.

    A null text and one without a letter are ``und`` with score 0; so is every
    text if there is no model. Equal counts go to the first language in order;
    a text with no known n-gram (or fewer than four bytes) gets the language of
    the fullest filter and score 0. Repeated rows are each judged.
    """
    prior = model.languages[int(np.argmax(model.false_rate))] if model else None
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_predict(model, prior), "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """The contract's split: crc32 of the id as text, mod 4, is 2. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_ids(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that aren't held out, then identify all rows."""
    model = fit(docs.filter(~held_out(docs["doc_id"])), **options)
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is clear: not ``und``, score >= least.

    Rows are matched by position in the pass, not by id, so repeated and null
    ids are no matter. Returns the columns of ``docs``.
    """
    model = fit(docs.filter(~held_out(docs["doc_id"])), **options)
    prior = model.languages[int(np.argmax(model.false_rate))] if model else None
    judge = _predict(model, prior)
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            for out in judge(iter([pair])):
                keep = [n != UNDETERMINED and s >= least for n, s in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, names=names)

    return through_arrow(docs, run, len(names))
