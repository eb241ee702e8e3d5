"""Hard negatives by norm-bucketed search of exact inner products.

All vectors are written once in descending order of their norm. Buckets are
stretches of that order, and by the Cauchy-Schwarz inequality no member of a
bucket scores more than the anchor's norm times the bucket's largest: a bucket
below a window's lower limit, or below the k-th best score that is known so far,
isn't multiplied, and rows below every limit of a batch aren't read.

Anchors come in batches of a bounded size, which every task gets, and vectors
stay where they are: no vector is shuffled for the search, and neither a frequent
label nor a frequent vector makes a task larger. A task keeps the best k for each
window; these few rows are merged by a window function. The first rows of the
order are searched ahead of the others, so that all tasks start with known scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, materialize, new_path

#: Vectors of a bucket, anchors multiplied with it at once, anchors of a batch, vectors searched first.
BUCKET, CHUNK, BATCH, FIRST = 4096, 512, 8192, 8192
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
_FOUND = "uid long, window int, anchor_id long, vec_id long, score long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, anchor, embedding of longs) -> width, norm and bytes."""
    for batch in batches:
        widths, norms, raws = [], [], []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False)
            wide = x.astype(np.float64)
            exact = not len(x) or np.abs(wide).max() < 1 << 24
            widths.append(len(x))
            norms.append(float(np.sqrt((wide * wide).sum())))
            raws.append(x.astype("<f4" if exact else "<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("vec_id", "label", "anchor")), pa.array(widths, pa.int32()), pa.array(norms, pa.float64()), pa.array(raws, pa.binary())],
            names=["vec_id", "label", "anchor", "width", "norm", "vector"],
        )


def _matrix(raws: list[bytes], width: int) -> np.ndarray:
    """Rows of numbers: doubles where they hold them, else whole numbers of any size."""
    if all(len(r) == 4 * width for r in raws):
        return np.frombuffer(b"".join(raws), "<f4").reshape(len(raws), width).astype(np.float64)
    return np.array([np.frombuffer(r, "<f4").astype(np.int64) if len(r) == 4 * width else np.frombuffer(r, "<i8") for r in raws], np.int64).reshape(len(raws), width)


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products, held at the limits of a long: doubles add whole
    numbers without loss as long as no partial sum can pass 2^53."""
    if bound < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T, _NONE + 1, _MOST).astype(np.int64)


class Anchors:
    """The anchors of a batch that have one width, and their windows.

    ``low``, ``high`` and ``floor`` have a row for each anchor and a column for
    each window; an unused window has a low limit above its high one.
    """

    def __init__(self, rows: list, width: int, windows: dict[int, list[tuple[int, int]]], same: bool, k: int):
        self.width, self.same, self.k = width, same, k
        self.uid = np.array([r["uid"] for r in rows], np.int64)
        self.vec_id = np.array([r["vec_id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.norm = np.array([r["norm"] for r in rows])
        self.x = _matrix([bytes(r["vector"]) for r in rows], width)
        n = max([1, *(len(w) for w in windows.values())])
        self.low, self.high = np.full((len(rows), n), _MOST), np.full((len(rows), n), _NONE)
        for i, u in enumerate(self.uid.tolist()):
            for j, (lo, hi) in enumerate(windows.get(u, ())):
                self.low[i, j], self.high[i, j] = lo, hi
        self.floor = self.low.copy()

    def known(self, uid: int, window: int, score: int) -> None:
        """The k-th best score of a window is ``score`` at least."""
        for i in np.flatnonzero(self.uid == uid):
            self.floor[i, window] = max(self.floor[i, window], score)


class _Best:
    """The k best (score descending, id ascending) of every window so far."""

    def __init__(self, q: Anchors):
        self.q = q
        self.score = np.full((*q.low.shape, q.k), _NONE)
        self.vec_id = np.full((*q.low.shape, q.k), _MOST)
        self.limit = q.floor.copy()

    def see(self, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, norm: float, raws: list[bytes]) -> None:
        q, y = self.q, None
        for k in range(0, len(q.uid), CHUNK):
            some = np.arange(k, min(k + CHUNK, len(q.uid)))
            reach = q.norm[some] * norm * (1 + 1e-9) + 1
            some = some[((reach[:, None] >= self.limit[some]) & (q.low[some] <= q.high[some])).any(axis=1)]
            if not len(some):
                continue
            y = _matrix(raws, q.width) if y is None else y
            s = _products(q.x[some], y, q.norm[some].max() * norm)
            fits = q.label[some][:, None] == labels[None, :]
            fits = fits & (q.uid[some][:, None] != uids[None, :]) if q.same else ~fits
            for j in range(q.low.shape[1]):
                r, c = np.nonzero(fits & (s >= self.limit[some, j][:, None]) & (s <= q.high[some, j][:, None]))
                if len(r):
                    self._merge(some, j, r, s[r, c], ids[c])

    def _merge(self, some: np.ndarray, j: int, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.q.k
        rows = np.unique(r)
        r = np.concatenate([r, np.repeat(rows, k)])
        score = np.concatenate([score, self.score[some[rows], j].ravel()])
        ids = np.concatenate([ids, self.vec_id[some[rows], j].ravel()])
        order = np.lexsort((ids, ~score, r))
        r, score, ids = r[order], score[order], ids[order]
        first = np.searchsorted(r, rows)
        at = first[:, None] + np.arange(k)  # every row has k entries at least, its own
        self.score[some[rows], j], self.vec_id[some[rows], j] = score[at], ids[at]
        self.limit[some[rows], j] = np.maximum(self.limit[some[rows], j], score[at][:, -1])

    def found(self) -> pa.RecordBatch:
        i, j, n = np.nonzero(self.score != _NONE)
        cols = [self.q.uid[i], j.astype(np.int32), self.q.vec_id[i], self.vec_id[i, j, n], self.score[i, j, n]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["uid", "window", "anchor_id", "vec_id", "score"])


def _searched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q.width: _Best(q) for q in sent.value}
        for batch in batches:
            width = batch.column("width").to_numpy()
            cuts = np.flatnonzero(np.diff(width)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(width)], strict=True):
                if a == b or int(width[a]) not in best:
                    continue
                for k in range(a, b, BUCKET):
                    part = batch.slice(k, min(BUCKET, b - k))
                    ids, uids, labels, norm = (part.column(c).to_numpy() for c in ("vec_id", "uid", "label", "norm"))
                    best[int(width[a])].see(ids, uids, labels, float(norm.max()), part.column("vector").to_pylist())
        for b in best.values():
            yield b.found()

    return run


def _search(table: DataFrame, batch: list, windows: dict[int, list[tuple[int, int]]], same: bool, k: int) -> DataFrame:
    """The first k rows of every window of a batch: the columns of _FOUND and place."""
    spark = table.sparkSession
    every = [Anchors([r for r in batch if r["width"] == w], w, windows, same, k) for w in sorted({r["width"] for r in batch})]
    best = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id")
    first = table.orderBy(F.desc("norm"), "uid").limit(FIRST).mapInArrow(_searched(spark.sparkContext.broadcast(every)), _FOUND)
    place = {u: q for q in every for u in q.uid.tolist()}
    for r in first.groupBy("uid", "window").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).collect():  # a row for each window of a batch
        place[r["uid"]].known(r["uid"], r["window"], r["least"])
    # rows that no window of the batch can reach are not read: norms are sorted, so row groups are skipped
    reach = [np.where(q.low <= q.high, q.floor, np.inf).min(axis=1) / np.maximum(q.norm, 1e-300) for q in every]
    least = float(min((r.min() for r in reach if len(r)), default=np.inf)) * (1 - 1e-6) - 1e-3
    rows = table.filter(F.col("norm") >= least) if least > 0 else table
    found = rows.mapInArrow(_searched(spark.sparkContext.broadcast(every)), _FOUND)
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives in a window.

    Needs vec_id (long), label (a whole number) and embedding (array<long>);
    ``anchor`` is a condition on them. An anchor's positives are the other rows
    of its label with the highest inner products, its negatives those of other
    labels with ``low`` % to ``high`` % of the positive's; equal scores go by the
    smaller vec_id. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a null vec_id, label, vector or component take no part. Rows that
    repeat a vec_id are rows of their own, as anchors and as partners. Vectors of
    different lengths are never compared; one of length 0 scores 0. Scores that
    don't fit a long are held at its limits. A positive score below 0 has an empty window.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"),
        F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)).alias("anchor"), vectors["embedding"].cast("array<long>").alias("embedding"),
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    packed = rows.mapInArrow(_pack, "vec_id long, label long, anchor boolean, width int, norm double, vector binary")
    order = ["width", F.desc("norm"), "vec_id"]
    table = materialize(packed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()), "by-norm")
    anchors = table.filter("anchor")
    n = -(-anchors.count() // BATCH)
    out, steps, schema = new_path(spark, "hard-negatives"), Scratch(spark, "hard-negatives-steps"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(n):
        batch = anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(n)) == b).collect()  # about BATCH anchors
        if not batch:
            continue
        near = steps.keep(_search(table, batch, {r["uid"]: [(_NONE + 1, _MOST)] for r in batch}, True, positives))
        scores: dict[int, set[int]] = {}
        for r in near.select("uid", "score").collect():  # ``positives`` an anchor of the batch
            scores.setdefault(r["uid"], set()).add(r["score"])
        # whole numbers s with low * score <= 100 * s <= high * score
        windows = {u: [(-(-low * p // 100), high * p // 100) for p in sorted(s)] for u, s in scores.items()}
        which = [(u, j, p) for u, s in scores.items() for j, p in enumerate(sorted(s))]
        far = _search(table, batch, windows, False, negatives)
        at = spark.createDataFrame(which, "uid long, window int, positive_score long")
        far = far.join(at, ["uid", "window"]).select("uid", "positive_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
        near = near.select("uid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        near.join(far, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        steps.drop()
    return spark.read.schema(schema).parquet(out) if n else spark.createDataFrame([], schema)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
