"""Signals of hybrid retrieval and their fusion.

All functions work on many queries at once: query rows carry ``query_id`` and
every ranking is a window per query with the evidence id as the last tie-break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import query_terms

RRF_K = 60
#: Queries that are compared with all items at a time.
BLOCK = 5_000
#: Distances that a task holds at a time, and components of items in double precision.
TILE = 1 << 18
HELD = 1 << 20
SIGNALS = ("exact", "text", "vector", "relation")


def ranked(df: DataFrame, *order: Column, by: tuple[str, ...] = ("query_id",), name: str = "rank", limit: int | None = None) -> DataFrame:
    """Positions 1..n of each query's rows in ``order``; the first ``limit``."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.filter(F.col(name) <= limit)


def text_overlap(queries: DataFrame, evidence: DataFrame, limit: int = 20) -> DataFrame:
    """Score = distinct exact-term hits + distinct content-term hits.

    ``queries``: query_id, query; ``evidence``: evidence_id, content, exact_terms.
    A join on terms, so only evidence that shares a term with a query moves.
    Nothing shared: no row (a fallback to score 1 would list all evidence).
    """
    wanted = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    content = evidence.select("evidence_id", F.explode(query_terms(F.col("content"))).alias("term"), F.lit(0).alias("exact"))
    exact = evidence.select("evidence_id", F.explode(F.array_distinct("exact_terms")).alias("term"), F.lit(1).alias("exact"))
    hits = content.unionByName(exact).join(wanted, "term").groupBy("query_id", "evidence_id").agg(F.count("*").alias("score"), (F.max("exact") == 1).alias("exact_match"))
    return ranked(hits, F.desc("score"), F.desc("exact_match"), F.asc("evidence_id"), limit=limit)


def exact_hits(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of which an exact term is a term of the query."""
    wanted = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    terms = evidence.select("evidence_id", F.explode("exact_terms").alias("term"))
    return ranked(terms.join(wanted, "term").select("query_id", "evidence_id").distinct(), F.asc("evidence_id"))


@dataclass(frozen=True)
class SearchQuery:
    """A web-style query: groups of alternatives, all of which must match.

    Each alternative is a phrase (a tuple of lexemes) and whether it is negated.
    """

    groups: tuple[tuple[tuple[tuple[str, ...], bool], ...], ...]

    @classmethod
    def parse(cls, text: str) -> SearchQuery:
        """AND by default, ``or`` between alternatives, ``-`` negates, quotes
        hold phrases; lower case, no stemming."""
        groups: list[list] = []
        join = False
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if word.lower() == "or" and not minus and groups:
                join = True
                continue
            lexemes = tuple(re.findall(r"[^\W_]+", (phrase or word).lower()))
            if not lexemes:
                continue
            if join:
                groups[-1].append((lexemes, bool(minus)))
            else:
                groups.append([(lexemes, bool(minus))])
            join = False
        return cls(tuple(tuple(g) for g in groups))

    def lexemes(self) -> list[str]:
        return sorted({w for g in self.groups for phrase, negated in g if not negated for w in phrase})

    def matches(self, tokens: Column) -> Column:
        """Over an array of lexemes in text order. An empty query matches nothing."""
        text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        out = F.lit(bool(self.groups))
        for group in self.groups:
            some = F.lit(False)
            for phrase, negated in group:
                hit = F.array_contains(tokens, phrase[0]) if len(phrase) == 1 else F.contains(text, F.lit(f" {' '.join(phrase)} "))
                some = some | (~hit if negated else hit)
            out = out & some
        return out


def lexemes_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def cover_density(lexemes: list[str], weight: float = 0.4):
    """A pandas UDF: the sum over minimal covers of weight per word in the cover.

    A cover is a shortest stretch that holds all lexemes; one of n lexemes over m
    words adds weight * n / m (the published cover density with one weight).
    """
    wanted = set(lexemes)

    @F.pandas_udf("double")
    def score(tokens: pd.Series) -> pd.Series:
        def one(words) -> float:
            last: dict[str, int] = {}
            total, used = 0.0, -1
            for i, w in enumerate(words):
                if w in wanted:
                    last[w] = i
                    if len(last) == len(wanted):
                        start = min(last.values())
                        if start > used:
                            total += weight * len(wanted) / (i - start + 1)
                            used = start
            return total

        return tokens.map(one)

    return score


def full_text(evidence: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Evidence that matches a web-style query, or has it as an exact term: exact
    ones first, then by cover density, then by id."""
    parsed = SearchQuery.parse(query)
    rows = evidence.withColumn("tokens", lexemes_of(F.col("content")))
    terms = evidence.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    exact = F.arrays_overlap("exact_terms", F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)
    rows = rows.withColumn("exact_match", F.coalesce(exact, F.lit(False))).filter(parsed.matches(F.col("tokens")) | F.col("exact_match"))
    rows = rows.withColumn("score", cover_density(parsed.lexemes())(F.col("tokens")) if parsed.lexemes() else F.lit(0.0))
    return rows.select("evidence_id", "exact_match", "score").orderBy(F.desc("exact_match"), F.desc("score"), "evidence_id").limit(limit)


def _nearest(sent, limit: int, digits: int):
    """Batches of items -> the best ``limit`` of the task for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, widths, unit, groups = sent.value
        best = np.full((len(ids), limit), np.inf)
        at = np.full((len(ids), limit), np.iinfo(np.int64).max)
        for batch in batches:
            own = batch.column("evidence_id").to_numpy()
            lists = batch.column("vector").combine_chunks() if isinstance(batch.column("vector"), pa.ChunkedArray) else batch.column("vector")
            size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            scope = batch.column("scope").to_numpy()
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                step = max(1, min(2048, HELD // max(1, int(width))))
                for r in range(0, len(rows), step):
                    part = rows[r : r + step]
                    if width > 0:
                        x = np.array(lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(part), width)
                        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                        x /= np.where(norm > 0, norm, 1)
                    wide = max(1, TILE // len(part))
                    for k in range(0, len(ids), wide):
                        q = np.arange(k, min(k + wide, len(ids)))
                        far = np.ones((len(q), len(part)))  # other lengths, and zero vectors: 1
                        same = np.flatnonzero(widths[q] == width)
                        if len(same) and width > 0:
                            far[same] = np.round(np.clip(1 - np.stack([unit[i] for i in q[same]]) @ x.T, 0, 2), digits)
                        far[np.isnan(far) | (groups[q][:, None] != scope[part][None, :])] = np.inf
                        worst = best[q, -1]
                        if len(part) > limit:  # of a tile no more than its own best and their ties
                            worst = np.minimum(worst, np.partition(far, limit - 1, axis=1)[:, limit - 1])
                        i, j = np.nonzero((far <= worst[:, None]) & (far < np.inf))
                        if not len(i):
                            continue
                        some = np.unique(i)
                        i2 = np.concatenate([i, np.repeat(some, limit)])
                        d2 = np.concatenate([far[i, j], best[q[some]].ravel()])
                        e2 = np.concatenate([own[part[j]], at[q[some]].ravel()])
                        order = np.lexsort((e2, d2, i2))
                        first = np.searchsorted(i2[order], some)[:, None] + np.arange(limit)
                        best[q[some]], at[q[some]] = d2[order][first], e2[order][first]
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(at[i, j]), pa.array(best[i, j])], names=["query_id", "evidence_id", "distance"])

    return run


def vector_topk(queries: DataFrame, items: DataFrame, limit: int = 20, digits: int = 9, within: tuple[str, ...] = (), state: str | None = None) -> DataFrame:
    """Exact cosine neighbours: query_id, evidence_id, distance, rank.

    ``queries``: query_id (long), vector, a stated set; ``items``: evidence_id
    (long), vector. ``within`` names columns of both (scope, profile) in which a
    query and an item must agree, nulls with nulls; ``state`` lets only items in
    that state take part. Queries go to all tasks in blocks of at most ``BLOCK``;
    items stay where they are, and each task multiplies them as matrices, ``TILE``
    distances at a time, and sends its best ``limit`` for a query. Ties by the smaller id. The distance is 1 for
    vectors of other lengths, null ones and those of norm 0; a null component is not a number.
    """
    spark = items.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    group = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in within]) if within else F.lit(0).cast("long")
    rows = items if state is None else items.filter(F.col("state") == state)
    rows = rows.select(F.col("evidence_id").cast("long").alias("evidence_id"), F.col("vector").cast("array<double>").alias("vector"), group.alias("scope"))
    out = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), group.alias("scope")).collect()  # about BLOCK vectors
        vectors = [np.array(r["vector"] if r["vector"] is not None else [], np.float64) for r in own]
        unit = [v / n if (n := np.sqrt((v * v).sum())) > 0 else v for v in vectors]
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in own], np.int64), np.array([len(v) for v in vectors], np.int64), unit, np.array([r["scope"] for r in own], np.int64)))
        scored = rows.mapInArrow(_nearest(sent, limit, digits), "query_id long, evidence_id long, distance double")
        best = ranked(scored, F.asc("distance"), F.asc("evidence_id"), limit=limit)
        out = best if out is None else out.unionByName(best)
    return out


def validate_vectors(items: DataFrame, dimension: int) -> DataFrame:
    """Rows that break a rule, with the reason: none if all are well."""
    from quarrylight.functions.vectors import finite, norm

    v = F.col("vector")
    reason = F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(~finite(v), "not_finite").when(norm(v) == 0, "zero_norm")
    bad = items.withColumn("reason", reason).filter("reason is not null").select("evidence_id", "reason")
    twice = items.groupBy("evidence_id").count().filter("count > 1").select("evidence_id", F.lit("duplicate").alias("reason"))
    return bad.unionByName(twice)


def weights_of(given: dict[str, float] | None) -> dict[str, float]:
    """All unset or zero: one each. Otherwise those not given are zero."""
    given = {s: float((given or {}).get(s, 0.0)) for s in SIGNALS}
    if any(w < 0 for w in given.values()):
        raise ValueError("weights can't be negative")
    return given if any(given.values()) else dict.fromkeys(SIGNALS, 1.0)


def fuse(signals: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the signals.

    Each signal has query_id, evidence_id, rank; of repeated evidence in a
    signal the best rank counts. Signals of weight 0 aren't read at all. Returns
    query_id, evidence_id, score, signals (their names in order), rank.
    """
    weights = weights_of(weights)
    parts = [
        df.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("rank")).select("query_id", "evidence_id", F.lit(name).alias("signal"), (F.lit(weights[name]) / (F.col("rank") + k)).alias("part"))
        for name, df in signals.items()
        if weights[name] > 0
    ]
    if not parts:
        raise ValueError("no signal has a weight")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "evidence_id").agg(F.round(F.sum("part"), 12).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))
    return ranked(fused, F.desc("score"), F.asc("evidence_id"), limit=limit)


def degradations(queries: DataFrame, fused: DataFrame, vector: DataFrame | None, relation: DataFrame | None) -> DataFrame:
    """query_id and the flags of what a query had to do without."""
    out = queries.select("query_id").join(fused.select("query_id").distinct().withColumn("some", F.lit(True)), "query_id", "left")
    flags = [F.when(F.lit(vector is None), "vector_unavailable"), F.when(F.lit(relation is None), "relation_unavailable"), F.when(F.col("some").isNull(), "no_retrieval_candidates")]
    return out.select("query_id", F.array_compact(F.array(*flags)).alias("degradations"))


def inconsistent_hashes(hits: DataFrame) -> DataFrame:
    """Evidence that the signals list with different content hashes: an error."""
    return hits.groupBy("query_id", "evidence_id").agg(F.count_distinct("content_hash").alias("hashes")).filter("hashes > 1")


def candidate_kind(signals: Column) -> Column:
    return F.when(F.array_contains(signals, "exact"), "symbol").when(F.array_contains(signals, "text") | F.array_contains(signals, "vector"), "text").otherwise("relation")


def relevance(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.01)), F.lit(1.0))
