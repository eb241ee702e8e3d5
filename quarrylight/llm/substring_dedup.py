"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are the lines of a text of at least ``min_words`` words, and runs of
neighbouring shorter lines that together have as many. The bands are tuned for
high recall at similarity 0.75: pairs there are missed with probability 1e-4.
Colliding paragraphs are joined and their exact Jaccard similarity of 5-word
shingles verified; components of verified links are clusters. Of a cluster the
first occurrence (smallest doc_id, then place) stays.

So that a passage inside other text is found as well, however its lines are
broken, windows of ``WINDOW`` words, which begin where the words themselves say,
are compared word for word, and those that overlap and come from the same first
document are one passage.

Equal paragraphs share a key and are handled once. Candidates come in two turns,
as near copies otherwise give all their pairs: first each bucket's paragraphs
with one of them, then of buckets that are not in one component yet all pairs
that share one of their rarest shingles, as similar ones must.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import _BYTE_FOLDED, _GAMMA, CHUNK, Hasher, Scratch, column, groups_of_texts, materialize, mix64, release, shingle_hashes, through_arrow, unused, utf8, word_ranges
from quarrylight.llm.components import connected_components
from quarrylight.llm.ngram_join import prefix_components, set_keys

#: Words of a paragraph at least (any number may be asked for), and of a window.
MIN_WORDS = 25
WINDOW = 25
#: Entries of bands in a fragment, about.
PER_FRAGMENT = 3_000_000
THRESHOLD = 0.75


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.9999, most: int = 100) -> tuple[int, int]:
    """(bands, rows): of all that reach the recall with at most ``most`` hashes,
    the one with the most rows, which lets the fewest others collide."""
    best = (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _windows(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and keys of windows of ``WINDOW`` words in runs of words.

    A window begins where a 5-word shingle has the least hash of ``WINDOW``
    neighbouring ones, so any passage of ``2 * WINDOW - 1`` words has the
    same window wherever it stands, and consecutive windows leave no gap; the
    first and the last words of a run have a window too.
    """
    w = WINDOW
    enough = last - first >= w
    first, last = first[enough], last[enough]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = mix64((np.arange(w, dtype=np.uint64) + np.uint64(101)) * _GAMMA) | np.uint64(1)
        grams = mix64(sum(h[j : len(h) - 4 + j] * c[j] for j in range(5)))
        # a window of starts lies in one run: its first start is no later than the run's last window less w - 1
        m = last - first - 2 * (w - 1)
        m = np.maximum(m, 0)
        lead = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
        least = lead + np.lib.stride_tricks.sliding_window_view(grams, w)[lead].argmin(axis=1) if len(lead) else lead
        at = np.unique(np.concatenate([least, first, last - w]))
        key = np.zeros(len(at), np.uint64)
        for j in range(w):
            key += h[at + j] * c[j]
    return at, mix64(key)


def _lines(data: np.ndarray, borders: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last + 1 word of each line, of words that start at ``s``:
    a line begins with the first word of a text and the first after a line feed."""
    feeds = np.cumsum(np.concatenate([[0], data == 10]))
    line = feeds[s] + np.searchsorted(borders[1:], s, "right")
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return first, np.concatenate([first[1:], [len(s)]])


def _runs(borders: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last + 1 word of each text that has words."""
    at = np.unique(np.searchsorted(s, borders))
    return at[:-1], at[1:]


def _blocks(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, last: np.ndarray, borders: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least two lines under the minimum, up to a blank line, a longer
    line or the text's end."""
    short = last - first < min_words
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    text = np.searchsorted(borders[1:], s[first], "right")
    joined = short[1:] & short[:-1] & (text[1:] == text[:-1]) & (feeds[s[first[1:]]] - feeds[e[last[:-1] - 1]] == 1)
    a = np.flatnonzero(np.concatenate([[True], ~joined]))
    b = np.concatenate([a[1:], [len(first)]]) - 1
    return first[a[b > a]], last[b[b > a]]


def _units(data: np.ndarray, borders: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs of texts that meet at ``borders``: hashes of all words, starts
    and ends of the words, and the first and the last + 1 word of each unit."""
    s, e = word_ranges(data, borders)
    if not len(s):
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), s, e, zero, zero
    h = Hasher(data, _BYTE_FOLDED).of(s, e)
    first, last = _lines(data, borders, s)
    a, b = _blocks(data, s, e, first, last, borders, min_words)
    first, last = np.concatenate([first, a]), np.concatenate([last, b])
    keep = last - first >= min_words
    order = np.lexsort((last[keep], first[keep]))
    return h, s, e, first[keep][order], last[keep][order]


def _unit_shingles(h: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of units (sorted, distinct), and how many each has."""
    n = last - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    x, n = shingle_hashes(h[at], n, k)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[new], np.bincount(owner[new], minlength=len(n))


def _bands(x: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Units x bands: 32 bits of a hash of each band's minimum hashes. More would
    only spare a few false candidates, which verification finds."""
    starts = np.cumsum(n) - n
    low = (x >> np.uint64(32)).astype(np.uint32)
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GAMMA)
    out = np.zeros((len(n), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(seeds.tolist()):
            y = (low ^ np.uint32(seed >> 32)) * np.uint32((seed | 1) & 0xFFFFFFFF)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(y, starts).astype(np.uint64)
            out[:, i // rows] = (out[:, i // rows] ^ least) * _GAMMA + np.uint64(i % rows)
    return (mix64(out) >> np.uint64(32)).astype(np.uint32)


_PARAGRAPHS = "doc_id long, start long, stop long, n_words int, key long, bands binary"


def _list_paragraphs(bands: int, rows: int, k: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in groups_of_texts(offsets, 2 * CHUNK):
                lo = int(offsets[i])
                part, borders = data[lo : int(offsets[j])], offsets[i : j + 1] - lo
                h, s, e, first, last = _units(part, borders, min_words)
                if not len(first):
                    continue
                x, n = _unit_shingles(h, first, last, k)
                doc = np.searchsorted(borders[1:], s[first], "right")
                table = _bands(x, n, bands, rows)
                columns = [
                    pa.array(names[i:j][doc]), pa.array(s[first] - borders[doc]), pa.array(e[last - 1] - borders[doc]), pa.array((last - first).astype(np.int32)),
                    pa.array(set_keys(x, n).view(np.int64)), pa.array([row.tobytes() for row in table], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "stop", "n_words", "key", "bands"])

    return run


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the windows of every text."""
    for batch in batches:
        names = batch.column(0).to_numpy()
        data, offsets = utf8(batch.column(1))
        for i, j in groups_of_texts(offsets, 2 * CHUNK):
            lo = int(offsets[i])
            part, borders = data[lo : int(offsets[j])], offsets[i : j + 1] - lo
            s, e = word_ranges(part, borders)
            if not len(s):
                continue
            at, key = _windows(Hasher(part, _BYTE_FOLDED).of(s, e), *_runs(borders, s))
            if not len(at):
                continue
            doc = np.searchsorted(borders[1:], s[at], "right")
            begin = np.searchsorted(s, borders[doc])  # the first word of the text
            columns = [pa.array(names[i:j][doc]), pa.array(s[at] - borders[doc]), pa.array(e[at + WINDOW - 1] - borders[doc]), pa.array(at - begin), pa.array(key.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "stop", "word", "key"])


_BITS = ("bits0", "bits1", "bits2", "bits3")


def _sets(k: int):
    """(text, places) -> key, n, items, bits of the paragraphs at those places. Rows that
    repeat a doc_id meet in a task, which remembers some 100,000 keys it has sent;
    a set sent twice changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            spans = [(offsets[row] + p["start"], min(offsets[row] + p["stop"], offsets[row + 1]), p["key"]) for row, places in enumerate(batch.column(1).to_pylist()) for p in places]
            for i in range(0, len(spans), 1024):  # paragraphs are hashed together, as texts that meet at borders
                parts = [data[a : max(a, b)] for a, b, _ in spans[i : i + 1024]]
                joined = np.concatenate(parts)
                borders = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                s, e = word_ranges(joined, borders)
                at = np.searchsorted(s, borders)
                h = Hasher(joined, _BYTE_FOLDED).of(s, e) if len(s) else np.zeros(0, np.uint64)
                x, n = _unit_shingles(h, at[:-1], at[1:], k)
                keys = np.array([key for _, _, key in spans[i : i + 1024]], np.int64)
                same = set_keys(x, n).view(np.int64) == keys  # else another text of this doc_id
                items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x.view(np.int64)))
                bits = np.zeros((len(n), 4), np.uint64)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(n)), n), (x >> np.uint64(6)) & np.uint64(3)), np.uint64(1) << (x & np.uint64(63)))
                rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32)), items, *[pa.array(bits[:, i].view(np.int64)) for i in range(4)]], names=["key", "n", "items", *_BITS])
                new = [ok and key not in seen and not seen.add(key) for ok, key in zip(same.tolist(), keys.tolist(), strict=True)]
                yield rows.filter(pa.array(new, pa.bool_()))
                if len(seen) > 100_000:
                    seen.clear()

    return run


def _scatter(fragment_bits: int):
    """(key, bands) -> (bucket, key) of every band, packed for each fragment of
    the bucket hashes: twelve bytes a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)[at]
            bands = table.shape[1]
            h = mix64((table.astype(np.uint64) | np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)).ravel())
            key = np.repeat(keys, bands)
            fragment = (h >> np.uint64(64 - fragment_bits)).astype(np.int32) if fragment_bits else np.zeros(len(h), np.int32)
            low = (h >> np.uint64(max(0, 32 - fragment_bits))).astype(np.uint32)
            order = np.argsort(fragment, kind="stable")
            borders = np.searchsorted(fragment[order], np.arange((1 << fragment_bits) + 1))
            full = [f for f in range(1 << fragment_bits) if borders[f] < borders[f + 1]]
            parts = [order[borders[f] : borders[f + 1]] for f in full]
            columns = [pa.array(full, pa.int32())] + [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (low, key)]
            yield pa.RecordBatch.from_arrays(columns, names=["fragment", "buckets", "keys"])

    return run


def _crowded(table: pa.Table) -> pa.Table:
    """One fragment's buckets -> (bucket, key, pivot) of those with two keys."""
    f = np.uint64(table.column("fragment")[0].as_py())
    low, key = (np.concatenate([np.frombuffer(x.as_py(), k) for x in table.column(c)]) for c, k in (("buckets", np.uint32), ("keys", np.int64)))
    order = np.lexsort((key, low))
    low, key = low[order], key[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])
    low, key = low[new], key[new]
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.concatenate([starts, [len(low)]]))
    pivot, many = np.repeat(key[starts], count), np.repeat(count > 1, count)
    bucket = (f << np.uint64(32) | low.astype(np.uint64)).view(np.int64)
    return pa.table({"bucket": bucket[many], "key": key[many], "pivot": pivot[many]})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("o", F.size(F.array_intersect("ia", "ib")))
    return joined.filter("7 * o >= 3 * (na + nb)").select("a", "b")


def _prefixes(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """item, key, n, shared, at, bits of the rarest shingles of the sets of these keys.

    Of two sets with similarity 0.75 the first n - ceil(0.75 n) + 1 shingles of
    each, in one order of all shingles, must have one in common. Rare ones first:
    paragraphs that have only a common passage in common, however many they are,
    don't meet.
    """
    each = keys.join(sets.dropDuplicates(["key"]), "key").select("key", "n", *_BITS, F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(often, "item")
    own = Window.partitionBy("key")
    shared = shared.withColumn("shared", F.count("*").over(own))
    # those that only this set has come first and match nothing
    shared = shared.withColumn("at", F.col("n") - F.col("shared") + F.row_number().over(own.orderBy("df", "item")) - 1)
    return shared.filter("at < n - ceil(0.75 * n) + 1").select("item", "key", "n", "shared", F.col("at").cast("int").alias("at"), *_BITS)


def paragraph_clusters(docs: DataFrame, k: int = 5, recall: float = 0.9999, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each paragraph that is in a cluster of at least two.

    doc_id, start, stop (bytes of the UTF-8 text), n_words, cluster, kept_doc_id,
    kept_start, removed (false for the one that stays). Rows with a null doc_id,
    null and empty texts and texts without a paragraph of ``min_words`` words
    have none; with ``min_words=1`` every line is a paragraph, and one of under
    five words its own only shingle. Repeated rows of one doc_id count as one.
    """
    spark = docs.sparkSession
    bands, rows = tune_bands(THRESHOLD, recall)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null")
    scratch = Scratch(spark, "substring-dedup")
    banded = scratch.keep(texts.mapInArrow(_list_paragraphs(bands, rows, k, min_words), _PARAGRAPHS))
    entries = banded.count() * bands
    bits = max(0, math.ceil(math.log2(max(1.0, entries / PER_FRAGMENT))))
    bits = max(bits, int(math.log2(max(1, min(16, int(spark.conf.get("spark.sql.shuffle.partitions")))))))
    packed = banded.select("key", "bands").mapInArrow(_scatter(bits), "fragment int, buckets binary, keys binary")
    crowded = scratch.keep(packed.groupBy("fragment").applyInArrow(_crowded, "bucket long, key long, pivot long"))
    found = materialize(banded.drop("bands"), "paragraphs")
    scratch.forget(banded)
    release(spark)
    # one occurrence stands for all with the same shingles
    wanted = found.join(crowded.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "start", "stop")).alias("first"))
    # a text's own places: never more than its paragraphs
    wanted = scratch.keep(wanted.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.start", "first.stop", "key")).alias("places")))
    sets = scratch.keep(texts.join(wanted, "doc_id").select("text", "places").mapInArrow(_sets(k), "key long, n int, items array<long>, " + ", ".join(f"{c} long" for c in _BITS)))
    release(spark)

    pairs = scratch.keep(crowded.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct())
    labels = connected_components(_verified(pairs, sets), "paragraph-components")
    release(spark)
    homed = scratch.keep(crowded.join(labels, F.col("key") == F.col("id"), "left").select("bucket", "key", F.coalesce("component", "key").alias("home")))
    mixed = scratch.keep(homed.groupBy("bucket").agg(F.min("home").alias("x"), F.max("home").alias("y")).filter("x < y").select("bucket"))
    places = scratch.keep(_prefixes(homed.join(mixed, "bucket").select("key").distinct(), sets))
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    components = prefix_components(places, labels, tried, lambda x: _verified(x, sets), scratch)
    scratch.drop()
    release(spark)

    placed = found.distinct().join(components, F.col("key") == F.col("id"), "left").select("doc_id", "start", "stop", "n_words", F.coalesce("component", "key").alias("cluster"))
    return _with_first(placed)


def _with_first(placed: DataFrame) -> DataFrame:
    """Places of clusters of at least two, with the first place of the cluster,
    which stays, and whether a place is to go."""
    kept = placed.groupBy("cluster").agg(F.min(F.struct("doc_id", "start", "stop")).alias("kept"), F.count("*").alias("members")).filter("members > 1")
    # a table of its own, so that a cluster with many places can be split in the join
    out = placed.join(materialize(kept.select("cluster", "kept"), "kept"), "cluster")
    # what overlaps the one that stays is a part of it
    stays = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("start") < F.col("kept.stop")) & (F.col("stop") > F.col("kept.start"))
    named = [c for c in placed.columns if c != "cluster"]
    return out.select(*named, "cluster", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), (~stays).alias("removed"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """One row for each window of ``WINDOW`` words that occurs at least twice,
    word for word (A-Z as a-z): columns as those of ``paragraph_clusters``, and
    word, the number of its first word."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null")
    windows = texts.mapInArrow(_list_windows, "doc_id long, start long, stop long, word long, key long")
    often = materialize(windows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    placed = materialize(windows.join(often, "key", "left_semi"), "windows").distinct()
    return _with_first(placed.withColumnRenamed("key", "cluster").withColumn("n_words", F.lit(WINDOW)))


def removals(docs: DataFrame, **options) -> DataFrame:
    """What to remove: doc_id, start, stop, n_words, cluster, kept_doc_id,
    kept_start. Repeated paragraphs, and outside of them repeated passages: runs
    of windows that overlap and were first in the same document."""
    paragraphs = materialize(paragraph_clusters(docs, **options).filter("removed").drop("removed"), "removals")
    release(docs.sparkSession)
    windows = repeated_windows(docs).filter("removed")
    spans = paragraphs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    inside = F.exists("spans", lambda x: (x["start"] <= F.col("start")) & (x["stop"] >= F.col("stop")))
    beside = windows.join(spans, F.col("doc_id") == F.col("id"), "left").filter(F.col("spans").isNull() | ~inside)
    run = Window.partitionBy("doc_id", "kept_doc_id").orderBy("start", "stop")
    beside = beside.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    beside = beside.withColumn("nth", F.sum(F.col("new").cast("int")).over(run))
    passages = beside.groupBy("doc_id", "kept_doc_id", "nth").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("word") - F.min("word") + WINDOW).cast("int").alias("n_words"), F.min("cluster").alias("cluster"), F.min("kept_start").alias("kept_start")
    )
    return paragraphs.unionByName(passages.select(paragraphs.columns))


def _without(at_text: int, at_spans: int, at_chars: int | None, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at_text).to_pylist(), batch.column(at_spans).to_pylist()
            new = []
            for text, cut in zip(texts, spans, strict=True):
                if text is None or not cut:
                    new.append(text)
                    continue
                raw, out, end = text.encode(), [], 0
                for start, stop in sorted((c["start"], c["stop"]) for c in cut):
                    if stop <= end:
                        continue
                    out.append(raw[end : max(start, end)])
                    end = stop
                out.append(raw[end:])
                lines = b"".join(out).decode().split("\n")
                gone = text.count("\n") + 1 if len(lines) > 1 else 0
                new.append("\n".join(x for x in lines if x.strip(" \t")) if gone else lines[0])
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at_text] = pa.array(new, pa.string())
            if at_chars is not None:
                changed = [len(t) if c and t is not None else v for t, c, v in zip(new, spans, batch.column(at_chars).to_pylist(), strict=True)]
                arrays[at_chars] = pa.array(changed, batch.column(at_chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated paragraphs and passages cut out of their texts.

    All rows stay, with the columns of ``docs``, whatever their names; lines left
    blank go with what was cut, and n_chars, if there is one, follows the text.
    """
    names = docs.columns
    own, cut = unused(names, "cut_id", "cut_spans")
    spans = removals(docs, **options).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("start", "stop")).alias(cut))
    joined = docs.join(spans, docs["doc_id"] == F.col(own), "left").select(*[column(docs, c) for c in names], cut)
    run = _without(names.index("text"), len(names), names.index("n_chars") if "n_chars" in names else None, [f"c{i}" for i in range(len(names))])
    return through_arrow(joined, run, len(names))
