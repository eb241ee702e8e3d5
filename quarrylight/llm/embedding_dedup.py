"""Embedding near-duplicates by random-hyperplane signs.

The signs of a vector's products with random hyperplanes, some bits to a table,
are its bucket in each of several tables. Vectors that share a bucket are
compared by their exact cosine in double precision. Bits and tables follow from
the number of vectors and the recall asked for: at the threshold itself a pair
is missed with probability 1 - recall at most.

Equal vectors are handled once, with their number. A bucket larger than
``block`` is cut into blocks whose pairs are compared in tasks of their own, and
a pair that meets in several tables counts in the first. Tasks send numbers of
links and, for each of their vectors, its smallest linked one, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import materialize
from quarrylight.llm.components import connected_components

THRESHOLD = 0.95


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = 0.9999) -> tuple[int, int]:
    """(bits, tables) for n vectors: about 32 vectors to a bucket if they were
    spread evenly, and enough tables for the recall."""
    bits = min(30, max(6, round(math.log2(max(2, n) / 32))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def _read_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> vec_id, key and bytes; null for one that can't be compared."""
    for batch in batches:
        keys, vectors = [], []
        for v in batch.column(1):
            v = np.array(v.as_py() if v.is_valid else [], object)
            x = None if not len(v) or any(e is None for e in v) else v.astype(np.float64) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                keys.append(None)
                vectors.append(None)
                continue
            raw = x.astype("<f4").tobytes() if (x.astype(np.float32) == x).all() else x.astype("<f8").tobytes()
            vectors.append(raw)
            keys.append(hashlib.blake2b(raw + bytes([len(raw) // len(x)]), digest_size=16).digest())
        width = [None if v is None else len(e) for v, e in zip(vectors, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "key", "vector", "width"])


def _decode(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * width else "<f8").astype(np.float64)


def _unit(raws: list[bytes], widths: list[int]) -> np.ndarray:
    x = np.array([_decode(r, w) for r, w in zip(raws, widths, strict=True)])
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge numbers leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column("width").to_pylist()
            raws = batch.column("vector").to_pylist()
            sign = np.zeros((len(raws), tables), np.uint32)
            for width in set(widths):
                at = [i for i, w in enumerate(widths) if w == width]
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, width]).standard_normal((width, bits * tables))
                for k in range(0, len(at), 1024):
                    some = at[k : k + 1024]
                    above = (_unit([raws[i] for i in some], [width] * len(some)) @ planes[width] >= 0).reshape(len(some), tables, bits)
                    sign[some] = above @ (1 << np.arange(bits, dtype=np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("width"), pa.array([s.tobytes() for s in sign], pa.binary()), pa.array(sign.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["cls", "width", "signs", "buckets"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(threshold: float):
    """Sorted rows of blocks -> (cls, links, other) of their vectors."""
    names = ["width", "turn", "bucket", "i", "j", "side", "cls", "copies", "vector", "signs"]

    def links(rows: list[tuple]) -> tuple[list, list, list] | None:
        i, j = rows[0][3], rows[0][4]
        left = [r for r in rows if r[5] == i]
        right = left if i == j else [r for r in rows if r[5] == j]
        if not left or not right or (i == j and len(left) < 2):
            return None
        turn, width = rows[0][1], rows[0][0]
        x = _unit([r[8] for r in left], [width] * len(left))
        y = x if i == j else _unit([r[8] for r in right], [width] * len(right))
        cos = x @ y.T
        a, b = np.nonzero(cos >= threshold)
        if i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return None
        sx = np.array([np.frombuffer(r[9], np.uint32) for r in left])
        sy = sx if i == j else np.array([np.frombuffer(r[9], np.uint32) for r in right])
        own = np.concatenate([(sx[a[k : k + 65536]] == sy[b[k : k + 65536]]).argmax(axis=1) == turn for k in range(0, len(a), 65536)])
        a, b = a[own], b[own]
        if not len(a):
            return None
        both = left if i == j else left + right
        if i != j:
            b = b + len(left)
        copies = np.array([r[7] for r in both])
        count = np.bincount(a, copies[b], len(both)) + np.bincount(b, copies[a], len(both))
        root = _roots(len(both), a, b)
        linked = np.flatnonzero(count)
        cls = [r[6] for r in both]
        return [cls[k] for k in linked], [int(count[k]) for k in linked], [cls[root[k]] for k in linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if pending and row[:5] != pending[0][:5]:
                    for o, x in zip(out, links(pending) or ((), (), ()), strict=True):
                        o.extend(x)
                    pending = []
                pending.append(row)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["cls", "links", "other"])
        if pending and (last := links(pending)):
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in last], names=["cls", "links", "other"])

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9999, block: int = 2048, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Needs vec_id and embedding (an array of numbers). A vector that is null,
    empty or zero, or has a null or non-finite number, links with nothing and is
    kept. Vectors of different lengths are never linked. Rows that repeat a
    vector, or a vec_id, are vectors of their own. kept is vec_id =
    component_id, the smallest vec_id of the component (false for a null vec_id).
    """
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"])
    read = materialize(rows.mapInArrow(_read_vectors, "vec_id long, key binary, vector binary, width int"), "vectors")
    valid = read.filter("key is not null")
    same = valid.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.max("vector").alias("vector"), F.max("width").alias("width"))
    classes = materialize(same.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signed = materialize(classes.select("cls", "width", "vector").mapInArrow(_signs(bits, tables, seed), "cls long, width int, signs binary, buckets array<long>"), "vector-signs")
    placed = signed.select("cls", "width", F.posexplode("buckets").alias("turn", "bucket"))
    key = ["width", "turn", "bucket"]
    crowded = placed.groupBy(*key).count().filter("count > 1").select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # every vector has one block of its bucket and meets each block once
    placed = placed.join(crowded, key).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cls", *key, "side", F.least("side", "to").alias("i"), F.greatest("side", "to").alias("j"))
    full = placed.join(classes.select("cls", "copies", "vector"), "cls").join(signed.select("cls", "signs"), "cls")
    group = ["width", "turn", "bucket", "i", "j"]
    full = full.select(*group, "side", "cls", "copies", "vector", "signs").repartition(*group).sortWithinPartitions(*group)
    found = materialize(full.mapInArrow(_compare(threshold), "cls long, links long, other long"), "vector-links")
    components = connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")), "vector-components")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    out = classes.select("key", "least", "copies", "cls").join(counts, "cls", "left").join(components, F.col("cls") == F.col("id"), "left")
    out = out.withColumn("root", F.coalesce("component", "cls"))
    least = out.groupBy("root").agg(F.min("least").alias("component_id"))
    out = out.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    final = read.select("vec_id", "key").join(out, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return final.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
