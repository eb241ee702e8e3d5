"""N-gram Jaccard join by vertical partitioning.

The order of all 5-word shingles (by hash) is cut into fragments, and a
document's set into one segment for each fragment. A fragment's task sees all
segments of its range, so it knows in how many sets each of its shingles is and
sends back those of at least two sets; the others can't be shared. A document
with fewer than 75 % of its shingles shared can't be linked and goes no further.

Candidate pairs are verified by their partial overlaps, one for each range of
fragments that holds shingles of both, counted by itself and summed for the
pair. Candidates come in two turns, so that large groups of near copies never
give all their pairs:

1. documents that agree in a few minimum hashes are paired with one of them, and
   verified links make first components; then documents of a
   prefix shingle are paired with one of its largest component;
2. the complete turn: documents that share a shingle of their prefix, rare
   shingles first (two sets with 75 % overlap must), and are not in one
   component yet. Pairs inside a component would change nothing.

Sets are compared by 54 or more bits of 64-bit hashes; equal sets share a key of
64 bits and are handled once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import _GAMMA, Scratch, column, groups_of_texts, materialize, mix64, release, shingle_hashes, unused, utf8, word_hashes
from quarrylight.llm.components import connected_components

#: Shingles of a fragment, about; and those that a task holds before it sends them.
PER_FRAGMENT = 3_000_000
HELD = 1_500_000
_SIGNATURES = 48
_SLICES = 3  # a fragment's shingles are put in order in 2**_SLICES parts
_SUPER = 2  # partial overlaps are counted in 2**_SUPER ranges of a pair's shingles
_SEED = np.uint64(0x5851F42D4C957F2D)

_BLOBS = "fragment int, keys binary, counts binary, hashes binary, doc_ids binary, doc_texts binary, doc_keys binary, doc_sizes binary"
_SEGMENTS = "bucket int, keys binary, counts binary, items binary, doc_ids binary, doc_texts binary, doc_keys binary, doc_sizes binary"


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and how many each has."""
    words, counts = word_hashes(data, offsets)
    h, n = shingle_hashes(words, counts, k)
    end = 0
    for size in n.tolist():
        h[end : end + size].sort()
        end += size
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[(np.cumsum(n) - n)[n > 0]] = True
    sums = np.concatenate([[0], np.cumsum(first)])
    ends = np.cumsum(n)
    return h[first], sums[ends] - sums[ends - n]


def set_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; sets with the same shingles have the same."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ _SEED), dtype=np.uint64)])
        ends = np.cumsum(n)
        return mix64(total[ends] - total[ends - n] + n.astype(np.uint64) * _GAMMA)


def _cut(fragment_bits: int, k: int):
    """(doc_id, text, text_id) -> the segments of each fragment, and the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[tuple] = []
        seen: set[int] = set()
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total
            h = np.concatenate([x[0] for x in held] or [np.zeros(0, np.uint64)])
            keys = np.concatenate([x[1] for x in held] or [np.zeros(0, np.uint64)])
            n = np.concatenate([x[2] for x in held] or [np.zeros(0, np.int64)])
            held.clear()
            ids, text_ids, doc_keys, sizes = (np.concatenate(x) for x in zip(*docs, strict=True))
            fragment = (h >> np.uint64(64 - fragment_bits)).astype(np.int32) if fragment_bits else np.zeros(len(h), np.int32)
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
            order = np.argsort(fragment, kind="stable")
            borders = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=1 << fragment_bits))])
            del fragment
            home = (doc_keys >> np.uint64(64 - fragment_bits)).astype(np.int64) if fragment_bits else np.zeros(len(doc_keys), np.int64)
            for f in range(1 << fragment_bits):
                at = order[borders[f] : borders[f + 1]]
                mine = home == f
                if not len(at) and not mine.any():
                    continue
                starts = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]])) if len(at) else np.zeros(0, int)
                counts = np.diff(np.concatenate([starts, [len(at)]]))
                low = (h[at] >> np.uint64(max(0, 16 - fragment_bits))) & np.uint64((1 << 48) - 1)
                row = [f, keys[owner[at][starts]].tobytes(), counts.astype(np.uint32).tobytes(), _pack48(low), ids[mine].tobytes(), text_ids[mine].tobytes(), doc_keys[mine].tobytes(), sizes[mine].astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32())] + [pa.array([x], pa.binary()) for x in row[1:]], names=["fragment", "keys", "counts", "hashes", "doc_ids", "doc_texts", "doc_keys", "doc_sizes"])
            docs.clear()
            total = 0

        for batch in batches:
            names, text_ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in groups_of_texts(offsets):
                h, n = distinct_shingles(data, offsets[i : j + 1], k)
                keys = set_keys(h, n)
                docs.append((names[i:j], text_ids[i:j], keys, n))
                fresh = np.array([size > 0 and not (key in seen or seen.add(key)) for key, size in zip(keys.tolist(), n.tolist(), strict=True)])
                if len(seen) > 100_000:
                    seen.clear()
                held.append((h[np.repeat(fresh, n)], keys[fresh], n[fresh]))
                total += len(held[-1][0])
                if total >= HELD:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _join_column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)] or [np.zeros(0, kind)])


def _buffers(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    """A binary column's values as arrays, without a copy."""
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]


def _shared(fragment_bits: int, buckets: int):
    """The segments of one fragment -> those of its shingles that two sets have.

    Shingles are put in order a slice of the fragment's range at a time, so the
    whole fragment is held only as it came and as what goes on.
    """
    below = np.uint64(max(0, fragment_bits + 48 - 55))

    def one(f: int, s: int, segments: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        low, keys = [], []
        for own, counts, raw in segments:
            at = np.flatnonzero(raw[:, 5] >> (8 - _SLICES) == s)
            low.append(_unpack48(raw[at].tobytes()))
            keys.append(np.repeat(own, counts)[at])
        h, keys = ((np.uint64(f) << np.uint64(48)) | np.concatenate(low)) >> below, np.concatenate(keys)
        if not len(h):
            return h, keys
        order = np.lexsort((keys, h))
        h, keys = h[order], keys[order]
        new = np.ones(len(h), bool)  # copies in other tasks have sent the same
        new[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])
        h, keys = h[new], keys[new]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([starts, [len(h)]]))
        df = np.repeat(n, n)
        h, keys, df = h[df > 1], keys[df > 1], df[df > 1]
        # rare first: the number of sets, in eighths of a doubling, above the hash
        return (np.minimum(8 * np.log2(df), 255).astype(np.uint64) << np.uint64(55)) | h, keys

    def run(table: pa.Table) -> pa.Table:
        f = table.column("fragment")[0].as_py()
        hashes = (x.reshape(-1, 6) for x in _buffers(table, "hashes", np.uint8))
        segments = list(zip(_buffers(table, "keys", np.uint64), _buffers(table, "counts", np.uint32), hashes, strict=True))
        found = [one(f, s, segments) for s in range(1 << _SLICES)]
        item, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        ids, text_ids, doc_keys, sizes = (_join_column(table, c, k) for c, k in (("doc_ids", np.int64), ("doc_texts", np.int64), ("doc_keys", np.uint64), ("doc_sizes", np.int64)))
        bucket, home = (keys % np.uint64(buckets)).astype(np.int32), (doc_keys % np.uint64(buckets)).astype(np.int64)
        rows = []
        for b in range(buckets):
            part, mine = np.flatnonzero(bucket == b), home == b
            if not len(part) and not mine.any():
                continue
            part = part[np.argsort(keys[part], kind="stable")]
            own = keys[part]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
            counts = np.diff(np.concatenate([starts, [len(own)]])).astype(np.uint32)
            rows.append((b, own[starts].tobytes(), counts.tobytes(), item[part].tobytes(), ids[mine].tobytes(), text_ids[mine].tobytes(), doc_keys[mine].tobytes(), sizes[mine].tobytes()))
        del item, keys, bucket
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.table([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["bucket", "keys", "counts", "items", "doc_ids", "doc_texts", "doc_keys", "doc_sizes"])

    return run


_SETS = "key long, n int, shared int, signature array<long>, prefix array<long>, range int, items array<long>"


def _bands(own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of runs of three and of four minimum hashes of a set: two sets that
    agree in one are very likely to have most shingles in common."""
    least = np.concatenate([mix64(own[None, :] ^ seeds[k : k + 8, None]).min(axis=1) for k in range(0, len(seeds), 8)])
    out = []
    with np.errstate(over="ignore"):
        for rows in (3, 4):
            band = np.zeros(len(seeds) // rows, np.uint64)
            for r in range(rows):
                band = mix64(band * _GAMMA + least.reshape(-1, rows)[:, r])
            out.append(band)
    return np.concatenate(out).astype(np.int64)


def _assemble(table: pa.Table) -> pa.Table:
    """The segments of some documents -> rows of those that can be linked: one
    with signature and prefix (range -1), and one for each range with its items.
    Documents are put in order in 2**_SLICES parts, by their keys."""
    doc_keys, at = np.unique(_join_column(table, "doc_keys", np.uint64), return_index=True)
    sizes = _join_column(table, "doc_sizes", np.int64)[at]
    segments = list(zip(*(_buffers(table, c, k) for c, k in (("keys", np.uint64), ("counts", np.uint32), ("items", np.uint64))), strict=True))
    parts = []
    for s in range(1 << _SLICES):
        keys, items = [], []
        for own, counts, raw in segments:
            mine = own >> np.uint64(64 - _SLICES) == s
            keys.append(np.repeat(own[mine], counts[mine]))
            items.append(raw[np.repeat(mine, counts)])
        mine = doc_keys >> np.uint64(64 - _SLICES) == s
        parts.append(_rows_of_sets(doc_keys[mine], sizes[mine], np.concatenate(keys), np.concatenate(items)))
    return pa.concat_tables(parts)


def _rows_of_sets(doc_keys: np.ndarray, sizes: np.ndarray, keys: np.ndarray, items: np.ndarray) -> pa.Table:
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    del order
    borders = np.searchsorted(keys, doc_keys)
    ends = np.searchsorted(keys, doc_keys, "right")
    out: dict[str, list] = {c: [] for c in ("key", "n", "shared", "signature", "prefix", "range", "items")}
    seeds = mix64(np.arange(1, _SIGNATURES + 1, dtype=np.uint64) * _GAMMA)
    for key, n, a, b in zip(doc_keys.astype(np.int64).tolist(), sizes.tolist(), borders.tolist(), ends.tolist(), strict=True):
        shared = b - a
        if n == 0 or 4 * shared < 3 * n:
            continue
        own = items[a:b]
        signature = _bands(own, seeds)
        # of the n - ceil(3n/4) + 1 first shingles those that only this set has are no use
        prefix = own[: n - (3 * n + 3) // 4 + 1 - (n - shared)].astype(np.int64)
        place = (own & np.uint64((1 << 55) - 1)) >> np.uint64(55 - _SUPER)
        by_range = [own[place == r].astype(np.int64) for r in range(1 << _SUPER)]
        for r, prefix_, signature_, part in [(-1, prefix, signature, None)] + [(r, None, None, p) for r, p in enumerate(by_range) if len(p)]:
            for c, v in (("key", key), ("n", n), ("shared", shared), ("signature", signature_), ("prefix", prefix_), ("range", r), ("items", part)):
                out[c].append(v)
    longs = pa.list_(pa.int64())
    types = {"key": pa.int64(), "n": pa.int32(), "shared": pa.int32(), "signature": longs, "prefix": longs, "range": pa.int32(), "items": longs}
    return pa.table({c: pa.array(out[c], t) for c, t in types.items()})


def _list_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        columns = [pa.array(_join_column(table, c, np.int64)) for c in ("doc_ids", "doc_texts", "doc_keys", "doc_sizes")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "key", "n_shingles"])


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union: partial overlaps
    are counted range by range and summed for the pair."""
    x = segments.select(F.col("key").alias("a"), F.col("n").alias("na"), "range", F.col("items").alias("ia"))
    y = segments.select(F.col("key").alias("b"), F.col("n").alias("nb"), "range", F.col("items").alias("ib"))
    partial = pairs.select("a", "b").join(x, "a").join(y, ["b", "range"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("o"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))
    return summed.filter("7 * overlap >= 3 * (na + nb)").select("a", "b")


def _in_mixed_company(places: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Prefix entries of shingles that two components share, with their home
    component and its size."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    known = labels.join(sizes, "component").select(F.col("id").alias("key"), F.col("component"), "size")
    placed = places.join(known, "key", "left").select(*places.columns, F.coalesce("component", "key").alias("home"), F.coalesce("size", F.lit(1)).alias("size"))
    placed = scratch.keep(placed)
    mixed = placed.groupBy("item").agg(F.min("home").alias("x"), F.max("home").alias("y")).filter("x < y").select("item")
    return placed.join(mixed, "item", "left_semi")


def prefix_components(places: DataFrame, labels: DataFrame, tried: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Components, as (id, component), of all pairs that share a prefix shingle.

    ``places``: item, key, n, shared, at of the shingles of each set's prefix (at:
    how many of its n come before; shared: how many other sets have), and perhaps
    bits0 to bits3, in which each shingle of the set has one bit set: what differs
    there differs in the sets. ``labels``: (id, component) known so far, from links
    among the pairs ``tried``, which aren't verified again. Only pairs across
    components are.
    """
    bits = [c for c in places.columns if c.startswith("bits")]
    # first with one other at each shingle: of edited copies of one text, the one
    # that shares most is closest to all
    mixed = _in_mixed_company(places, labels, scratch)
    most = mixed.groupBy("item").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), "size", "home", "key", "n")).alias("p"))
    star = mixed.join(most, "item").filter("home <> p.home and 4 * n >= 3 * p.n and 4 * p.n >= 3 * n")
    star = star.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    star = scratch.keep(star)
    labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(verify(star)), "star-components")
    release(places.sparkSession)

    # then every pair that shares one
    left = _in_mixed_company(places, labels, scratch)
    p = left.select("item", F.col("key").alias("a"), F.col("home").alias("ha"), F.col("n").alias("na"), F.col("at").alias("pa"), *[F.col(c).alias(f"{c}_a") for c in bits])
    q = left.select("item", F.col("key").alias("b"), F.col("home").alias("hb"), F.col("n").alias("nb"), F.col("at").alias("pb"), *[F.col(c).alias(f"{c}_b") for c in bits])
    # at the first shared shingle nothing before it overlaps: the rest must be enough
    enough = "ha <> hb and a < b and 4 * na >= 3 * nb and 4 * nb >= 3 * na and 7 * (1 + least(na - pa - 1, nb - pb - 1)) >= 3 * (na + nb)"
    if bits:  # a similar pair differs in a seventh of its shingles at most
        enough += f" and 7 * ({' + '.join(f'bit_count({c}_a ^ {c}_b)' for c in bits)}) <= na + nb"
    more = scratch.keep(p.join(q, "item").filter(enough).select("a", "b").distinct().join(tried.union(star), ["a", "b"], "left_anti"))
    return connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(verify(more)), "components")


def jaccard_classes(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, components) of the join at similarity 0.75.

    documents: doc_id, text_id (a hash of the text), key, n_shingles of every row
    with a doc_id; rows with the same set have the same key. components: key,
    component of every key that is linked with another. A null or wordless text
    has an empty set and is linked with nothing, even with others like it.
    Repeated rows are copies.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("text_id")).filter("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / 6 / PER_FRAGMENT)))))
    bits = max(bits, int(np.floor(np.log2(max(1, min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))))))
    shared = rows.mapInArrow(_cut(bits, k), _BLOBS).groupBy("fragment").applyInArrow(_shared(bits, 1 << bits), _SEGMENTS)
    scratch = Scratch(spark, "ngram-join")
    shared = scratch.keep(shared)
    release(spark)
    listed = shared.filter(F.octet_length("doc_ids") > 0).select("doc_ids", "doc_texts", "doc_keys", "doc_sizes")
    documents = materialize(listed.mapInArrow(_list_documents, "doc_id long, text_id long, key long, n_shingles long"), "shingle-sets")
    sets = scratch.keep(shared.drop("doc_ids", "doc_texts").groupBy("bucket").applyInArrow(_assemble, _SETS))
    scratch.forget(shared)
    release(spark)
    segments = sets.filter("range >= 0").select("key", "n", "range", "items")
    heads = sets.filter("range = -1")

    # first turn: one partner for each run of minimum hashes
    signed = heads.select("key", F.posexplode("signature").alias("turn", "value"))
    pivots = signed.groupBy("turn", "value").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    pairs = scratch.keep(signed.join(pivots, ["turn", "value"]).filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct())
    labels = connected_components(verified(pairs, segments), "first-components")
    release(spark)

    unique = F.col("n") - F.col("shared")
    places = heads.select("key", "n", "shared", unique.alias("u"), F.posexplode("prefix").alias("i", "item"))
    places = scratch.keep(places.select("item", "key", "n", "shared", (F.col("u") + F.col("i")).cast("int").alias("at")))
    components = prefix_components(places, labels, pairs, lambda x: verified(x, segments), scratch)
    scratch.drop()
    release(spark)
    return documents, components


def _least_members(documents: DataFrame, components: DataFrame) -> DataFrame:
    """key, doc_id, text_id for every key of a set that isn't empty: the smallest
    (doc_id, text_id) of its component. Copies meet by partial minima, and only
    keys, not rows, are joined with components."""
    firsts = documents.filter("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id", "text_id")).alias("first"))
    rooted = materialize(firsts.join(components, F.col("key") == F.col("id"), "left").select("key", "first", "component"), "firsts")
    least = materialize(rooted.filter("component is not null").groupBy("component").agg(F.min("first").alias("least")), "least-members")
    found = rooted.filter("component is not null").join(least, "component").select("key", "least.*")
    return materialize(found.union(rooted.filter("component is null").select("key", "first.*")), "members")


def jaccard_join(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the own included. A
    row with a null doc_id is not compared: its n_shingles and component_id are null.
    """
    documents, components = jaccard_classes(docs, k)
    least = _least_members(documents, components).select("key", F.col("doc_id").alias("component_id"))
    out = documents.filter("n_shingles > 0").join(least, "key").select("doc_id", "n_shingles", "component_id")
    alone = documents.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nothing = F.lit(None).cast("long")
    nameless = docs.filter(docs["doc_id"].isNull()).select(nothing.alias("doc_id"), nothing.alias("n_shingles"), nothing.alias("component_id"))
    return out.union(alone).union(nameless)


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, whatever their names: of
    each component the row with the smallest doc_id, and all rows without a link.

    Rows with a null doc_id aren't compared and stay. Of rows alike in doc_id and
    text one stays; rows that share only a doc_id are told apart by their texts.
    """
    documents, components = jaccard_classes(docs, k)
    least = _least_members(documents, components).select("doc_id", "text_id").distinct()
    alone = documents.filter("n_shingles = 0").select("doc_id", "text_id").distinct()
    stay, text, alike = unused(docs.columns, "stays_id", "stays_text", "stays_alike")
    counts = documents.groupBy(F.col("doc_id").alias(stay), F.col("text_id").alias(text)).agg(F.count("*").alias(alike))
    kept = least.union(alone).toDF(stay, text).join(counts, [stay, text])
    kept = materialize(kept, "stay")
    same = (docs["doc_id"] == F.col(stay)) & (F.xxhash64(docs["text"]) == F.col(text))
    once = docs.join(kept.filter(F.col(alike) == 1), same, "left_semi")
    # rows that repeat are few kinds: one of each, by partial aggregation
    often = docs.join(kept.filter(F.col(alike) > 1), same).select(stay, text, F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))
    often = often.groupBy(stay, text).agg(F.first("row").alias("row")).select("row.*")
    return once.union(often).unionByName(docs.filter(docs["doc_id"].isNull()))
