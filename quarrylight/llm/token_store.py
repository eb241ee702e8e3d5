"""Token ids as directly addressable codes.

Each id is cut into chunks of eight bits. Level 0 holds the low chunk of every
id; a bitmap beside it marks the ids that continue, whose next chunks form level
1, and so on. A rank directory (ones before every 512th bit) turns the position
of an id in one level into its position in the next with a bounded count, so any
token can be read alone, without decoding a block.

File format: a Parquet table of blobs, one for about ``blob_tokens`` ids of
consecutive documents, in ascending doc_id order (null first): ``part`` and
``seq`` (order of the blobs), ``before`` (ids in the part before the blob),
``n_tokens``, ``doc_ids``, ``counts`` (ids of each document) and ``codes`` (the
bytes of :class:`DirectCodes`). Any file system that Spark writes will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import utf8
from quarrylight.llm.tokenizing import encoder

_MAGIC = b"DAC1"
_SPAN = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class DirectCodes:
    """A sequence of unsigned 32-bit ids with random access."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels = np.asarray(ids, np.uint32), []
        n = len(rest)
        while True:
            more = rest > 255
            bitmap = np.packbits(more, bitorder="little")
            ones = _ONES[bitmap].astype(np.uint32)
            per_span = np.add.reduceat(ones, np.arange(0, len(ones), _SPAN // 8)) if len(ones) else ones
            directory = np.concatenate([[0], np.cumsum(per_span)]).astype(np.uint32)
            levels.append(((rest & 255).astype(np.uint8), bitmap, directory))
            rest = rest[more] >> 8
            if not len(rest):
                return cls(n, levels)

    def to_bytes(self) -> bytes:
        out = [_MAGIC, struct.pack("<QI", self.n, len(self.levels))]
        for parts in self.levels:
            for p in parts:
                out += [struct.pack("<Q", len(p)), p.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DirectCodes:
        if raw[:4] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n, depth = struct.unpack_from("<QI", raw, 4)
        at, levels = 16, []
        for _ in range(depth):
            parts = []
            for kind in (np.uint8, np.uint8, np.dtype("<u4")):
                (size,) = struct.unpack_from("<Q", raw, at)
                parts.append(np.frombuffer(raw, kind, size, at + 8))
                at += 8 + parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(n, levels)

    def _rank(self, level: int, i: int) -> int:
        """Continuing ids before position i of a level."""
        _, bitmap, directory = self.levels[level]
        span = i // _SPAN
        whole = _ONES[bitmap[span * _SPAN // 8 : i // 8]].sum(dtype=np.int64)
        rest = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(directory[span]) + int(whole) + int(_ONES[rest])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id: a chunk and a rank a level, whatever the length."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range, touching only their chunks."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        chunks, bitmap, _ = self.levels[0]
        out = chunks[start:stop].astype(np.uint32)
        where, shift = slice(None), 0
        for level in range(len(self.levels)):
            chunks, bitmap, _ = self.levels[level]
            if level:
                shift += 8
                out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            first = start // 8
            bits = np.unpackbits(bitmap[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first].view(bool)
            if not bits.any():
                break
            where = np.flatnonzero(bits) if level == 0 else where[bits]
            start = self._rank(level, start)
            stop = start + len(where)
        return out


BLOBS = "part int, seq long, before long, n_tokens long, doc_ids array<long>, counts array<long>, codes binary"


def _blobs(path: str, end_id: int, blob_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        seq = before = held = 0
        docs: list = []
        parts: list[np.ndarray] = []

        def blob() -> pa.RecordBatch:
            nonlocal seq, before, held, docs, parts
            ids = np.concatenate(parts)
            row = {"part": part, "seq": seq, "before": before, "n_tokens": len(ids), "doc_ids": docs, "counts": [len(p) for p in parts], "codes": DirectCodes.of(ids).to_bytes()}
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            seq, before, held, docs, parts = seq + 1, before + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for k in range(0, len(names), 256):
                ids, counts = enc.encode(data, offsets[k : k + 257])
                end = np.cumsum(counts)
                for name, a, b in zip(names[k : k + 256], end - counts, end, strict=True):
                    docs.append(name)
                    parts.append(np.append(ids[a:b], np.uint32(end_id)))
                    held += len(parts[-1])
                    if held >= blob_tokens:
                        yield blob()
        if docs:
            yield blob()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, blob_tokens: int = 1 << 20) -> None:
    """Tokenise ``text`` and write it to ``path`` in ascending doc_id order.

    Null texts and empty texts have just ``end_id``; a null doc_id comes first;
    rows that share a doc_id are all kept, ordered by text. A blob is closed at
    the first document that fills it, so memory is bounded by ``blob_tokens``
    and the longest text.
    """
    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blobs(tokenizer_path, end_id, blob_tokens), BLOBS).write.parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one number for each written part reaches the driver."""
    rows = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(rows):
        out[r["part"]] = total
        total += r["n"]
    return out


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids (array), ids_crc32."""
    return _read(spark, path, True)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_token_store`, but without the ids themselves."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    starts = part_starts(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, names, counts, raw = (batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "counts", "codes"))
                ids = DirectCodes.from_bytes(raw).slice(0, sum(counts)).astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(begins + before + starts[part], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.parquet(path).select("part", "before", "doc_ids", "counts", "codes").mapInArrow(run, schema)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a position of the whole store, read from its one blob."""
    starts = part_starts(spark, path)
    part = max((p for p, s in starts.items() if s <= position), key=lambda p: (starts[p], p), default=None)
    if part is None or position < 0:
        return None
    local = position - starts[part]
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("before") <= local) & (F.col("before") + F.col("n_tokens") > local)).select("before", "codes").first()
    return None if row is None else DirectCodes.from_bytes(bytes(row["codes"]))[local - row["before"]]
