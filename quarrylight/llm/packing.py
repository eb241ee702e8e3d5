"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the
driver. There the configuration linear program (which ways to fill a sequence,
how often each) is solved by multiplicative weights: a length's price falls with
what of its pieces is covered, a knapsack by dynamic programming finds the
dearest ways to fill a sequence, for every length the dearest with it, and those
within a few per cent of the best are used. The solution is rounded to whole
sequences, those used most first, and the linear program is solved anew for what
is left, until little is; the last of the pieces go best fit. The result is
a table of runs (a length's pieces of these ranks go to those sequences), from
which each task computes the places of its own pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialize, utf8
from quarrylight.llm.tokenizing import encoder

Pattern = tuple[tuple[int, int], ...]
#: Of the linear program, each time that it is solved.
ITERATIONS = 200


class Knapsack:
    """The dearest fillings of every room up to the capacity, each length as often
    as it fits: dynamic programming over the room left."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths, self.prices, self.capacity = lengths, prices, capacity
        self.best = best = np.zeros(capacity + 1)
        n_fit = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
        for room in range(int(lengths[0]), capacity + 1):
            k = n_fit[room]
            best[room] = max(0.0, (best[room - lengths[:k]] + prices[:k]).max())

    def with_each(self) -> np.ndarray:
        """For each length the price of the dearest filling that has it."""
        return self.prices + self.best[self.capacity - self.lengths]

    def filling(self, first: int, most: np.ndarray) -> np.ndarray:
        """Indices of the lengths of a filling that begins with ``first`` and goes
        on with the dearest, no length more often than ``most`` has it."""
        room, out, left = self.capacity, [], most.copy()
        k = first
        while True:
            out.append(k)
            left[k] -= 1
            room -= int(self.lengths[k])
            fits = int(np.searchsorted(self.lengths, room, "right"))
            if not fits:
                break
            value = np.where(left[:fits] > 0, self.best[room - self.lengths[:fits]] + self.prices[:fits], -1.0)
            k = int(value.argmax())
            if value[k] <= 0:
                break
        return np.array(out)


def fractional_patterns(histogram: dict[int, int], capacity: int, iterations: int, rate: float = 0.5, worth: float = 16.0, slack: float = 0.004, batch: int = 96) -> tuple[dict[Pattern, float], float]:
    """(how often to use which filling, a lower bound on the sequences needed).

    Multiplicative weights for the covering linear program, which begin with a
    price of a piece as its length. In an iteration the
    fillings within ``slack`` of the dearest are used, the least covered lengths
    first, each so often that no length is covered more than once over in it. It
    ends when all lengths are covered several times over, or after ``iterations``
    once all are covered; uses are scaled to one covering of all tokens. The bound
    is the dual solution: no filling is dearer than the dearest.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths], float)
    covered = np.zeros(len(lengths))
    use: dict[Pattern, float] = {}
    bound, step = 0.0, 0
    while covered.min() < 40 and (step < iterations or covered.min() == 0):
        step += 1
        ahead = np.clip(rate * (covered - covered.mean()), -4, 4)
        price = lengths + worth * (np.exp(-ahead) - np.exp(ahead))
        sack = Knapsack(lengths, price, capacity)
        bound = max(bound, float(np.maximum(price, 0) @ demand) / sack.best[capacity])
        value = sack.with_each()
        near = np.flatnonzero(value >= (1 - slack) * sack.best[capacity])
        gained = np.zeros(len(lengths))
        for k in near[np.argsort(covered[near], kind="stable")][:batch].tolist():
            if gained[k] >= 1:
                continue
            at, times = np.unique(sack.filling(k, demand), return_counts=True)
            x = float(((1 - gained[at]) * demand[at] / times).min())
            if x <= 1e-9:
                continue
            pattern = tuple((int(lengths[i]), int(a)) for i, a in zip(at[::-1], times[::-1], strict=True))
            use[pattern] = use.get(pattern, 0.0) + x
            gained[at] += times * x / demand[at]
        covered += gained
    scale = float(covered @ (lengths * demand) / (lengths @ demand))
    return {p: x / scale for p, x in use.items()}, bound


def plan(histogram: dict[int, int], capacity: int, iterations: int = ITERATIONS) -> list[tuple[Pattern, int]]:
    """Fillings and how many sequences have them; every piece is in one."""
    return [(p, n) for p, n, _ in planned(histogram, capacity, iterations)]


def planned(histogram: dict[int, int], capacity: int, iterations: int = ITERATIONS, rest: float = 0.06) -> list[tuple[Pattern, int, bool]]:
    """As ``plan``, and whether the linear program gave the filling: it does for all
    but ``rest`` of the tokens, which go best fit."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[Pattern, int, bool]] = []
    if capacity in left:
        out.append((((capacity, 1),), left.pop(capacity), True))
    total = sum(n * c for n, c in left.items())
    while len(left) > 1 and (tokens := sum(n * c for n, c in left.items())) > max(rest * total, 2 * capacity):
        # half of each use, rounded; where all uses are parts of one, those used most
        # until half of the tokens have their place. What is left is solved anew, so
        # that small errors of a solution don't use up the short pieces
        uses, _ = fractional_patterns(left, capacity, iterations)
        order, placed = sorted(uses.items(), key=lambda p: (-p[1], p[0])), 0
        for share, least in ((0.5, 0), (0.0, 1)):
            for pattern, x in order if placed < 0.2 * tokens else ():
                if least and placed > 0.5 * tokens:
                    break
                times = min([max(least, int(share * x + 0.5))] + [left.get(n, 0) // a for n, a in pattern])
                if times < 1:
                    continue
                out.append((pattern, times, True))
                for n, a in pattern:
                    placed += n * a * times
                    left[n] -= a * times
                    if not left[n]:
                        del left[n]
        if not placed:
            break
    out = topped_up(out, left, capacity)
    # best fit for the rest: the largest, then again and again the largest that fits
    while left:
        sizes = sorted(left, reverse=True)
        room, counts = capacity, {}
        for n in sizes:
            a = min(room // n, left[n])
            if a:
                counts[n] = a
                room -= a * n
        times = min(left[n] // a for n, a in counts.items())
        out.append((tuple(counts.items()), times, False))
        for n, a in counts.items():
            left[n] -= a * times
            if not left[n]:
                del left[n]
    return out


def topped_up(fillings: list[tuple[Pattern, int, bool]], left: dict[int, int], capacity: int) -> list[tuple[Pattern, int, bool]]:
    """The fillings with pieces exchanged for longer ones of the rest, so that they
    have no room left or less of it; ``left`` gets the shorter pieces instead.

    As many sequences hold more tokens, and the rest, which goes best fit, has fewer.
    """
    out, todo = [], list(fillings)
    while todo:
        pattern, times, solved = todo.pop()
        room = capacity - sum(n * a for n, a in pattern)
        for gain in range(room, 0, -1):
            found = next(((n, k) for n, _ in pattern if (k := min(times, left.get(n + gain, 0)))), None)
            if not found:
                continue
            n, k = found
            counts = dict(pattern)
            counts[n] -= 1
            counts[n + gain] = counts.get(n + gain, 0) + 1
            new = tuple(sorted(((m, a) for m, a in counts.items() if a), reverse=True))
            left[n] = left.get(n, 0) + k
            left[n + gain] -= k
            if not left[n + gain]:
                del left[n + gain]
            (out if gain == room else todo).append((new, k, solved))
            times -= k
            if not times:
                break
        if times:
            out.append((pattern, times, solved))
    return out


@dataclass
class Runs:
    """Pieces of one length with ranks from rank[k] on: copies[k] to a sequence,
    from sequence[k] on, the first at offset[k]."""

    key: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, planned: list[tuple[Pattern, int]]) -> Runs:
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in planned:
            offset = 0
            for n, a in pattern:
                rows.append((n << 44 | rank.get(n, 0), sequence, a, offset))
                rank[n] = rank.get(n, 0) + a * times
                offset += n * a
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*table.T)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        behind = rank - (self.key[k] & ((1 << 44) - 1))
        return self.sequence[k] + behind // self.copies[k], self.offset[k] + behind % self.copies[k] * length


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            rows: dict[str, list] = {c.split()[0]: [] for c in _PIECES.split(", ")}
            for k in range(0, len(names), 256):
                ids, counts = enc.encode(data, offsets[k : k + 257])
                end = np.cumsum(counts)
                for name, a, b in zip(names[k : k + 256], end - counts, end, strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    cuts = list(range(len(own), 0, -capacity))[::-1]  # the first piece has the rest
                    at = 0
                    for i, cut in enumerate(cuts):
                        size = cut - at
                        for c, v in zip(rows, (name, i, at, size, zlib.crc32(own[at:cut]), part, int(met[size])), strict=True):
                            rows[c].append(v)
                        met[size] += 1
                        at = cut
            types = {"piece": pa.int32(), "part": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in rows.items()], names=list(rows))

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A document is its ids and ``end_id``; a null text is empty, so every row has
    a piece. Only a document of more than ``capacity`` ids is cut, and only its
    first piece is shorter. Repeated rows and null ids are packed like others.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = Runs.of(plan(histogram, capacity, iterations))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = runs.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
