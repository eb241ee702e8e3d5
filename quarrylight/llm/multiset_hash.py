"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (a line between line feeds, the empty one too) is hashed to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane
by lane modulo a power of two. So the order of paragraphs is no matter, equal
multisets have equal fingerprints, and a paragraph is put in or taken out by
adding or subtracting its vector, without the rest of the text.

A vector has two parts. ``LANES`` lanes modulo 2^16 are uniform: an extendable
hash of the whole paragraph. They tell multisets apart (4,096 bits: no chance
collision; against a search for collisions take 1,024 lanes or more).
``LANES`` lanes modulo 2^32 hold the paragraph's distinct ``GRAM``-byte
substrings, each as +1 or -1 in one lane. The inner products of such sums estimate
those of the counts of substrings, so the cosine of two fingerprints says how much
their texts share, with a standard error of about 1/16. Both parts add up alike.

The edited texts need each document's follower, hence one shuffle of the texts
into ranges of their ids. Each range also gets a copy of the first document of
the next, so no task needs more than its own range.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import _BYTE_EXACT, CHUNK, Hasher, groups_of_texts

#: ``GRAM`` bytes a substring, ``SHORT`` in lines of fewer than twice GRAM bytes.
LANES, GRAM, SHORT = 256, 8, 2
#: Bytes of text of a range, and ranges at most; splits are taken from 20 sampled ids a range.
RANGE_BYTES, RANGES, SAMPLED = 64 << 20, 50_000, 20
_MASKS = np.repeat(np.array([0xFFFF, 0xFFFFFFFF], np.int64), LANES)
_LEAST = -(1 << 63)


def _uniform(lines: list[bytes], owner: np.ndarray, out: np.ndarray) -> None:
    """Add the uniform lanes of every line to those of its text."""
    for k in range(0, len(lines), 4096):
        raw = b"".join([hashlib.shake_128(x).digest(2 * LANES) for x in lines[k : k + 4096]])
        some = owner[k : k + 4096]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        out[some[first], :LANES] += np.add.reduceat(np.frombuffer(raw, "<u2").reshape(-1, LANES).astype(np.int64), first, axis=0)


def _substrings(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Add the signs of the distinct substrings of each line to those of its text.

    Lines follow each other without a gap and none is empty. In a line of more
    than CHUNK bytes each stretch of so many bytes counts for itself.
    """
    for a, b in groups_of_texts(offsets):
        for lo in range(int(offsets[a]), int(offsets[b]), CHUNK) if b - a == 1 else [int(offsets[a])]:
            hi = min(int(offsets[b]), lo + CHUNK) if b - a == 1 else int(offsets[b])
            starts, ends = offsets[a:b], offsets[a + 1 : b + 1]
            size = np.minimum(ends, hi) - np.maximum(starts, lo)
            line = np.repeat(np.arange(b - a), size)
            gram = np.where(ends - starts < 2 * GRAM, SHORT, GRAM)[line]
            pos, stop = np.arange(lo, hi), ends[line]
            fits = (pos + gram <= stop) | (pos == starts[line])  # a line of fewer bytes is one substring
            pos, stop, line = pos[fits], np.minimum(pos + gram, stop)[fits], line[fits]
            h = Hasher(data[lo : hi + GRAM], _BYTE_EXACT).of(pos - lo, stop - lo)
            key = np.sort((line.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))  # at most 2^18 lines
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            unit = owner[a:b][(key >> np.uint64(44)).astype(np.int64)]
            base, n = int(unit[0]), int(unit[-1] - unit[0]) + 1
            slot = (unit - base) * LANES + (key % np.uint64(LANES)).astype(np.int64)
            sums = np.bincount(slot, weights=np.where(key >> np.uint64(43) & np.uint64(1), 1.0, -1.0), minlength=n * LANES)
            out[base : base + n, LANES:] += sums.astype(np.int64).reshape(n, LANES)


def vectors(units: list[bytes | None]) -> np.ndarray:
    """The sums of the vectors of the paragraphs of each unit of UTF-8 text.

    None has no paragraph, the empty string has an empty one.
    """
    out = np.zeros((len(units), 2 * LANES), np.int64)
    lines: list[bytes] = []
    counts = np.zeros(len(units), np.int64)
    for i, u in enumerate(units):
        if u is not None:
            own = u.split(b"\n")
            counts[i] = len(own)
            lines += own
    if lines:
        owner = np.repeat(np.arange(len(units)), counts)
        _uniform(lines, owner, out)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        full = sizes > 0
        _substrings(np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum(sizes[full])]), owner[full], out)
    return out & _MASKS


def encode(vector: np.ndarray) -> str:
    return base64.b64encode(vector[:LANES].astype("<u2").tobytes() + vector[LANES:].astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    return np.concatenate([np.frombuffer(raw, "<u2", LANES), np.frombuffer(raw, "<u4", LANES, 2 * LANES)]).astype(np.int64)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text; a null or empty one has no paragraph."""
    return encode(vectors([text.encode() if text else None])[0])


def changed(before: str, insert: list[str] = (), delete: list[str] = ()) -> str:
    """A fingerprint after paragraphs are put in and taken out, one by one."""
    parts = vectors([p.encode() for p in (*insert, *delete)])
    return encode((decode(before) + parts[: len(insert)].sum(axis=0) - parts[len(insert) :].sum(axis=0)) & _MASKS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of vectors: 1 if they are equal, else the cosine of the
    substring lanes, 0 at least (and 0 where one has none)."""
    x, y = (((v[:, LANES:] + (1 << 31)) % (1 << 32) - (1 << 31)).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cos = np.clip((x * y).sum(axis=1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, cos)


def _halves(text: str) -> tuple[bytes | None, int, int]:
    """The paragraphs that an edit of the last quarter can't touch (None: no
    such), where the others begin, and where the edit does."""
    cut = len(text) - len(text) // 4
    line = text.rfind("\n", 0, cut) + 1
    return (text[: line - 1].encode() if line else None), line, cut


class _Stream:
    """Documents in order; each is done when the next one of its range is known."""

    def __init__(self):
        self.last = None  # range, id, text, vector, vector of the paragraphs before the edit's

    def rows(self, ranges: list[int], copies: list[bool], ids: list, texts: list[str]) -> pa.RecordBatch:
        halves = [_halves(t) for t in texts]
        sums = vectors([h for h, _, _ in halves] + [t[line:].encode() if t else None for t, (_, line, _) in zip(texts, halves, strict=True)])
        heads = sums[: len(texts)]
        whole = (heads + sums[len(texts) :]) & _MASKS
        if self.last is not None:
            ranges, ids, texts = [self.last[0], *ranges], [self.last[1], *ids], [self.last[2], *texts]
            whole, heads, copies = np.vstack([self.last[3], whole]), np.vstack([self.last[4], heads]), [self.last[5], *copies]
            halves = [_halves(texts[0]), *halves]
        done = [i for i in range(len(texts) - 1) if ranges[i] == ranges[i + 1] and not copies[i]]
        edited, tails = [], []
        for i in done:
            _, line, cut = halves[i]
            put = texts[i + 1][: len(texts[i]) - cut]
            edited.append(hashlib.sha256((texts[i][:cut] + put).encode()).hexdigest())
            tails.append((texts[i][line:cut] + put).encode() if texts[i] else None)
        own, after = whole[done], whole[[i + 1 for i in done]]
        new = (heads[done] + vectors(tails)) & _MASKS
        self.last = (ranges[-1], ids[-1], texts[-1], whole[-1:], heads[-1:], copies[-1])
        cols = [
            pa.array([ids[i] for i in done], pa.int64()), pa.array([len(texts[i]) for i in done], pa.int64()), pa.array(edited, pa.string()),
            pa.array([encode(v) for v in own], pa.string()), pa.array([encode(v) for v in new], pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = _Stream()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield stream.rows(*(part.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text")))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            texts = batch.column(1).slice(k, 256).to_pylist()
            sums = vectors([t.encode() if t else None for t in texts])
            cols = [batch.column(0).slice(k, 256), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(v) for v in sums], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every row, without a shuffle."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(_alone, "doc_id long, n_chars long, fingerprint string")


def _range_of(splits: list[tuple[int, int]]):
    """The number of splits that are no greater than (id, tie)."""
    ids, ties = np.array([s[0] for s in splits], np.int64), np.array([s[1] for s in splits], np.int64)

    @F.pandas_udf("int")
    def of(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        out = np.searchsorted(ids, k, "left")
        split = np.flatnonzero(ids[np.minimum(out, len(ids) - 1)] == k) if len(ids) else []
        for i in split:  # an id at which a range begins
            out[i] += np.searchsorted(ties[out[i] : np.searchsorted(ids, k[i], "right")], t[i], "right")
        return pd.Series(out.astype(np.int32))

    return of


def edited_fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many of the next document by ascending doc_id (fewer where it is
    shorter); the first follows the last. Its fingerprint is the text's with the
    changed paragraphs taken out and put in. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness of the
    text's fingerprint to the edited text's) and near_next (to the next text's).

    A null text is an empty one; empty texts equal their edited texts. A null
    doc_id comes first. Rows that share a doc_id are all kept, ordered by a hash
    of their texts and then the texts, so a repeated id is split into ranges.
    A document alone is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(_LEAST)), "tie": F.xxhash64("text")})
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["bytes"] / range_bytes)))
    share = min(1.0, SAMPLED * n / max(1, size["n"]))
    sampled = sorted((r["key"], r["tie"]) for r in rows.select("key", "tie").sample(share, 5).collect())  # about SAMPLED pairs of numbers a range
    splits = sorted({sampled[k * len(sampled) // n] for k in range(1, n)}) if sampled else []
    rows = rows.withColumn("range", _range_of(splits)("key", "tie"))
    firsts = rows.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first")).orderBy("range").collect()  # a row for each range
    before = [(r["first"]["key"], r["first"]["tie"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    where = spark.createDataFrame(before, "key long, tie long, before int")
    copies = rows.select("doc_id", "text", "key", "tie").join(F.broadcast(where), ["key", "tie"]).groupBy("key", "tie", "before").agg(F.min("text").alias("text"))
    columns = ["range", "copy", "key", "tie", "text", "doc_id"]
    every = rows.withColumn("copy", F.lit(False)).select(*columns).unionByName(copies.select(F.col("before").alias("range"), F.lit(True).alias("copy"), "key", "tie", "text", F.lit(None).cast("long").alias("doc_id")))
    dealt = every.repartitionById(n, "range").sortWithinPartitions("range", "copy", "key", "tie", "text")
    return dealt.mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
