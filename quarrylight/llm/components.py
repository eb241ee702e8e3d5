"""Connected components of an edge table, without collecting it.

Each task first contracts its own edges to stars. Then large-star and small-star
steps alternate: each moves edges towards the smallest neighbour and keeps the
components, until nothing changes. Only joins and aggregations with partial sums
are used, so hubs are split or pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components: each id with the smallest it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        a, b = contracted(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.inline(ends))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"))
    return edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("u")).join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").filter("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: long): component is the
    smallest id reachable. Loops, repeated edges and nulls are left out; ids
    without an edge to another don't appear. No edges: no rows."""
    steps = Scratch(edges.sparkSession, name)
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    now, seen = steps.keep(now.mapInArrow(_contract, "a long, b long").distinct()), None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if found["n"] == 0 or (found["n"], found["x"]) == seen:
            break
        seen = (found["n"], found["x"])
        large = steps.keep(_large_star(now))
        now = steps.keep(_small_star(large).mapInArrow(_contract, "a long, b long").distinct())
        steps.drop(but_last=True)
    out = steps.keep(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct()))
    steps.drop(but_last=True)
    return out
