"""Shared pieces of the training-data operators: durable intermediate tables
and vectorised word hashing over UTF-8 buffers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at a time, so that scratch arrays stay small.
CHUNK = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    ``spark.checkpoint.dir`` of the session; only where it is unset and the
    master is local (tests, a single machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarrylight-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrylight/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """Each name, lengthened until no column has it (cases are no difference)."""
    seen, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def through_arrow(df: DataFrame, run, n: int) -> DataFrame:
    """``df.mapInArrow(run)`` for any column names: ``run`` gets the columns as
    c0, c1, ... and returns the first ``n`` of them."""
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(names[:n], df.schema.fields, strict=False)])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns[:n])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those with a map in them, which Spark doesn't hash, as JSON."""

    def hashed(field: T.StructField) -> Column:
        own = column(df, field.name)
        return F.to_json(F.struct(own.alias("c")), {"ignoreNullFields": "false"}) if "map<" in field.dataType.simpleString() else own

    return F.xxhash64(*[hashed(f) for f in df.schema.fields])


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and broadcasts that no DataFrame needs any more:
    Spark removes them when the driver collects what referred to them, which
    long jobs of small plans hardly ever make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables that go once the results are written: what a lazy
    result still reads must not be kept here."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *, but_last: bool = False) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in range(1, self.n + 1 - but_last):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{k}")
            path.getFileSystem(conf).delete(path, True)

    def forget(self, *tables: DataFrame) -> None:
        """Delete these tables, which nothing reads any more, before the others."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(conf).delete(path, True)


# --- words and shingles of UTF-8 buffers -------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256)
_FOLD[65:91] += 32
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: A random 64-bit value for each byte, A-Z as a-z; and the same with cases kept.
_BYTE_FOLDED = mix64((_FOLD.astype(np.uint64) + np.uint64(1)) * _GAMMA)
_BYTE_EXACT = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GAMMA)
_R = 0xD1342543DE82EF95
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, r, np.uint64)]), dtype=np.uint64) for r in (_R, _R_INVERSE)
            ]
    return _powers[0], _powers[1]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data, offsets


def _pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Cut [lo, hi) after white space into stretches of about CHUNK bytes."""
    while hi - lo > CHUNK:
        step = CHUNK
        while True:
            found = np.flatnonzero(_IS_SPACE[data[lo : min(hi, lo + step)]])
            if len(found) or lo + step >= hi:
                break
            step *= 2
        if not len(found):
            break
        yield lo, lo + int(found[-1]) + 1
        lo += int(found[-1]) + 1
    yield lo, hi


class Hasher:
    """Prefix sums of a stretch of bytes: the hash of any range in constant time."""

    def __init__(self, part: np.ndarray, table: np.ndarray):
        up, self.down = _pow(len(part) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], dtype=np.uint64, out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[ends] - self.total[starts]) * self.down[starts]
            return mix64(h + (ends - starts).astype(np.uint64) * _GAMMA)


def word_ranges(part: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that meet at ``borders``."""
    word = np.zeros(len(part) + 2, bool)
    word[1:-1] = ~_IS_SPACE[part]
    change = word[1:] != word[:-1]
    inner = borders[(borders > 0) & (borders < len(part))]
    joined = inner[word[inner] & word[inner + 1]]  # a text ends and the next begins with a word
    edges = np.flatnonzero(change)
    if len(joined):
        edges = np.sort(np.concatenate([edges, np.unique(joined), np.unique(joined)]))
    return edges[0::2], edges[1::2]


def groups_of_texts(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the words of each text."""
    table = _BYTE_FOLDED if fold_case else _BYTE_EXACT
    hashes, starts = [], []
    for i, j in groups_of_texts(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a, b in _pieces(data, lo, hi) if j - i == 1 else [(lo, hi)]:
            s, e = word_ranges(data[a:b], offsets[i : j + 1] - a)
            hashes.append(Hasher(data[a:b], table).of(s, e))
            starts.append(s + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(s, offsets, "left"))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and how many each has.

    A text of fewer than k words, but at least one, has its whole sequence as
    its one shingle.
    """
    ends = np.cumsum(counts)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), n
    with np.errstate(over="ignore"):
        c = mix64((np.arange(k, dtype=np.uint64) + np.uint64(11)) * _GAMMA) | np.uint64(1)
        padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
        h = words * c[0]
        for j in range(1, k):
            h = h + (padded[j : j + len(words)] ^ (padded[j : j + len(words)] >> np.uint64(29))) * c[j]
        h = mix64(h)
        # word positions that start a shingle: not among the last k-1 of a long text
        starts = ends - counts
        keep = np.ones(len(words), bool)
        long = counts >= k
        for j in range(1, k):
            keep[ends[long] - j] = False
        short = (counts > 0) & ~long
        keep[np.repeat(short, counts)] = False
        first = starts[short]
        if len(first):
            keep[first] = True
            for i, a, m in zip(np.flatnonzero(short), first, counts[short], strict=True):
                v = np.uint64(m)
                for w in words[a : a + m]:
                    v = mix64(np.array([v * _GAMMA + w]))[0]
                h[a] = v
    return h[keep], n


def by_text(counts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(index, slice) of each text's run in a concatenated array."""
    end = 0
    for i, n in enumerate(counts.tolist()):
        yield i, slice(end, end + n)
        end += n
