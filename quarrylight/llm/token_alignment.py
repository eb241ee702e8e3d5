"""Alignment of the tokens of two vocabularies, once for each distinct segment.

A text is split before white-space runs that follow visible text, begin with a
space or a line feed and are followed by visible text. Neither vocabulary merges
across such a place: the byte-level one cuts its text there before it merges, and
the piece vocabulary is checked to have no piece that holds its space mark after
another character, or a line feed. So a text's tokens are those of its segments,
and both vocabularies have a token end at every split: groups and links never
reach over one.

Texts become chunks: a dictionary of distinct segments, and for each document the
numbers of its segments. Segments are counted over all chunks, tokenised and
aligned once each, and their links are counted and scored by joins. Last, every
chunk's dictionary gets its alignments back by a join, and its documents are put
together from the numbers. So what is shuffled is a row for each segment of a
chunk's dictionary, not one for each occurrence, and no text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, new_path, release

#: Bytes of text of a chunk, and segments that are tokenised at a time.
CHUNK_BYTES, TOGETHER = 32 << 20, 4096
#: White space and what follows, up to the next split; white space at the end goes with what is before.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:\s+\Z)?")
_MARK = "▁"
_CHUNK = "chunk long, local int, segment string, n long, doc_ids array<long>, sizes array<long>, codes binary"
_ALIGNED = "segment string, n long, groups string, n_a int, links array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def segments(text: str) -> list[str]:
    """The segments of the space and ``text``, in order."""
    return _SEGMENT.findall(" " + text) or [" " + text]


def check_pieces(path: str) -> None:
    """Raise ValueError unless splits are safe for a piece vocabulary, and every
    text without its space mark is spelt by its tokens."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, kinds = model.normalizer_spec, model.SentencePiece
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        raise ValueError(f"{path} changes its texts")
    if sum(p.type == kinds.BYTE for p in model.pieces) != 256 or any(p.type == kinds.USER_DEFINED for p in model.pieces):
        raise ValueError(f"{path} has no token for each byte, or tokens of the user's")
    if any("\n" in p.piece or _MARK in p.piece.lstrip(_MARK) for p in model.pieces if p.type == kinds.NORMAL):
        raise ValueError(f"{path} has pieces that reach over a split")


class _Chunk:
    """Documents as numbers of a dictionary of segments."""

    def __init__(self):
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.doc_ids: list = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        # with the space mark in it, a text isn't what its pieces spell
        own = segments(text) if text and _MARK not in text else []
        self.doc_ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.number.__getitem__, own), np.uint32, len(own)))
        self.bytes += len(text or "") + 8

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("local", pa.int32()), ("segment", pa.string()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary())])
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.number))
        often = np.argsort(-counts, kind="stable")  # frequent segments get small numbers, which pack well
        rank = np.empty(len(often), "<u4")
        rank[often] = np.arange(len(often))
        packed = pa.compress(rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "doc_ids": self.doc_ids, "sizes": [len(c) for c in self.codes], "codes": packed}], schema)
        counts, said = counts[often], np.array(list(self.number), object)[often].tolist() if len(often) else []
        for k in range(0, len(said), 1 << 16):
            some = said[k : k + (1 << 16)]
            no = lambda kind: pa.nulls(len(some), kind)
            cols = [pa.array(np.full(len(some), chunk)), pa.array(np.arange(k, k + len(some), dtype=np.int32)), pa.array(some, pa.string()), pa.array(counts[k : k + len(some)].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, no(pa.list_(pa.int64())), no(pa.list_(pa.int64())), no(pa.binary())], schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, n, now = TaskContext.get().partitionId() << 32, 0, _Chunk()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for doc_id, text in zip(batch.column(0).slice(k, 256).to_pylist(), batch.column(1).slice(k, 256).to_pylist(), strict=True):
                now.add(doc_id, text)
                if now.bytes >= CHUNK_BYTES:
                    yield from now.rows(first + n)
                    n, now = n + 1, _Chunk()
    if now.doc_ids:
        yield from now.rows(first + n)


class Aligner:
    """Tokenises segments by both vocabularies and links tokens that share a byte."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_size = {i: len(t) for t, i in self.a.get_vocab().items()}  # a character of a byte-level token is a byte
        n = self.b.get_piece_size()
        self.b_size = [1 if self.b.is_byte(i) else len(self.b.id_to_piece(i).replace(_MARK, " ").encode()) for i in range(n)]
        self.mark = self.b.piece_to_id(_MARK)

    def tokens(self, some: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of segments; the piece vocabulary puts the first space before a text by itself."""
        a = self.a.encode_batch_fast(some, add_special_tokens=False)
        b = self.b.encode([s[1:] if s[0] == " " else s for s in some], num_threads=1)
        for s, x, y in zip(some, a, b, strict=True):
            if s[0] != " ":
                if y[0] != self.mark:
                    raise ValueError(f"a piece reaches over the start of {s[:40]!r}")
                y = y[1:]
            yield x.ids, y

    def align(self, a: list[int], b: list[int]) -> tuple[str, list[int]]:
        """Groups as ``a1,a2|b1;a3|b2,b3`` and the linked pairs, as a * 2^32 + b."""
        groups, links = [], []
        i = j = since_a = since_b = 0
        end_a, end_b = self.a_size[a[0]], self.b_size[b[0]]
        while True:
            links.append((a[i] << 32) + b[j])
            if end_a == end_b:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, a[since_a:i]))}|{','.join(map(str, b[since_b:j]))}")
                since_a, since_b = i, j
                if i == len(a) or j == len(b):
                    break
                end_a, end_b = end_a + self.a_size[a[i]], end_b + self.b_size[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += self.a_size[a[i]]
            else:
                j += 1
                end_b += self.b_size[b[j]]
        if i != len(a) or j != len(b):
            raise ValueError("tokens don't spell the same bytes")
        return ";".join(groups), links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """This process's aligner for two vocabulary files, kept from task to task."""
    key = (bytes_path, pieces_path)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _align(bytes_path: str, pieces_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(bytes_path, pieces_path)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                groups, n_a, links = [], [], []
                for a, b in own.tokens(part.column("segment").to_pylist()):
                    g, pairs = own.align(a, b)
                    groups.append(g)
                    n_a.append(len(a))
                    links.append(pairs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("segment"), part.column("n"), pa.array(groups, pa.string()), pa.array(n_a, pa.int32()), pa.array(links, pa.list_(pa.int64()))],
                    names=["segment", "n", "groups", "n_a", "links"],
                )

    return run


def _compose(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk's documents from the alignments of its dictionary."""
    local = known["local"].to_numpy()
    groups = np.empty(len(local), object)
    groups[local] = known["groups"].to_pylist()
    sums = np.zeros((len(local), 6), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum
    of = lambda x: pc.cast(x, pa.int64()).to_numpy()
    n_a, n_groups = of(known["n_a"]), of(pc.count_substring(known["groups"], ";")) + 1
    n_b = of(pc.count_substring(known["groups"], ",")) + 2 * n_groups - n_a
    sums[local] = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, of(known["n_best"]), of(known["count_sum"])], axis=1)
    ids, out, digests = [], [], []
    for doc_ids, sizes, packed in zip(*(chunk[c].to_pylist() for c in ("doc_ids", "sizes", "codes")), strict=True):
        planes = np.frombuffer(pa.decompress(packed, 4 * sum(sizes), codec="zstd", asbytes=True), np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
        codes = planes.reshape(4, -1).T.copy().view("<u4").ravel()
        end = 0
        for size in sizes:
            own, end = codes[end : end + size], end + size
            total = np.zeros(6, np.int64)
            said = hashlib.sha256()
            for k in range(0, size, 1 << 16):
                some = own[k : k + (1 << 16)]
                total += sums[some].sum(axis=0)
                said.update((";" * bool(k) + ";".join(groups[some])).encode())
            out.append(total)
            digests.append(said.hexdigest() if size else "")
        ids += doc_ids
    table = np.array(out, np.int64).reshape(-1, 6)
    return pa.table([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(6)), pa.array(digests, pa.string())], names=[c.split()[0] for c in _RESULT.split(", ")])


def _written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`materialize`, but packed closer; what the jobs before have shuffled goes."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(2):  # the last job's plan is let go of a little later than its tables
        release(df.sparkSession)
        time.sleep(0.5)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align_documents(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """How the tokens of a byte-level vocabulary (A) and a piece vocabulary (B) meet.

    A encodes the space and the text, B the text, to which it puts the space. The
    byte offsets where tokens of both end cut them into groups; tokens that share
    a byte are linked. Returns for each row doc_id, n_a, n_b, n_groups, n_links,
    n_best (links whose pair has its B id's highest count over the corpus, ties
    included), count_sum (the pairs' counts over the document's links) and
    groups_sha256.

    A null or empty text, and one with U+2581, which B's pieces can't spell, has
    no tokens: zeros, and '' for the digest. Rows that repeat a doc_id or a text
    are documents of their own and all count. An empty table gives no rows.
    ValueError if B's vocabulary fails :func:`check_pieces`.
    """
    check_pieces(pieces_path)
    spark = docs.sparkSession
    steps = Scratch(spark, "alignment")
    chunks = _written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_chunks, _CHUNK), "chunks")
    known = chunks.filter("segment IS NOT NULL")
    counted = known.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = steps.keep(counted.mapInArrow(_align(bytes_path, pieces_path), _ALIGNED).withColumn("id", F.monotonically_increasing_id()))
    counts = steps.keep(aligned.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count")))
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    scores = steps.keep(counts.withColumn("b", b).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).cast("int").alias("best")))
    # a segment's text isn't shuffled with each of its links
    links = aligned.select("id", F.explode("links").alias("link")).join(scores, "link")
    totals = steps.keep(links.groupBy("id").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")))
    scored = _written(aligned.select("id", "segment", "groups", "n_a").join(totals, "id").drop("id"), "segment-scores")
    steps.drop()
    back = known.select("chunk", "local", "segment").join(scored, "segment").drop("segment")
    payload = chunks.filter("codes IS NOT NULL").select(F.col("chunk").alias("whole"), "doc_ids", "sizes", "codes")
    return payload.groupBy("whole").cogroup(back.groupBy("chunk")).applyInArrow(_compose, _RESULT)
