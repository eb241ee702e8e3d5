"""Memory of tasks that meet many queries, whatever their number."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quarrylight.llm import ngram_join
from quarrylight.operators import index, quality
from quarrylight.operators.retrieval import _nearest


def test_vector_search_holds_a_tile_at_a_time():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(6_000, 8)), 1)
    x[5] = 0.0
    x[6, 3] = np.nan
    x[200:400] = x[100]  # ties, broken by ids
    q = x[rng.permutation(len(x))[:1_500]]
    q = q[np.isfinite(q).all(axis=1)]
    length = lambda v: np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-300)
    scopes = np.arange(len(q)) % 2
    own = rng.permutation(len(x)).astype(np.int64)
    sent = SimpleNamespace(value=(np.arange(len(q)), np.full(len(q), 8), list(q / length(q)), scopes))
    batch = pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(x), pa.list_(pa.float64())), pa.array(own % 2)], names=["evidence_id", "vector", "scope"])
    tracemalloc.start()
    (out,) = _nearest(sent, 20, 9)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    got = {}
    for k, e, d in zip(*(c.to_pylist() for c in out.columns), strict=True):
        got.setdefault(k, []).append((d, e))
    for k in range(0, len(q), 50):
        far = np.round(np.clip(1 - (x / length(x)) @ (q[k] / length(q[k])), 0, 2), 9)
        want = sorted((d, e) for d, e in zip(far.tolist(), own.tolist(), strict=True) if e % 2 == scopes[k] and d == d)[:20]
        assert [e for _, e in sorted(got[k])] == [e for _, e in want]


def test_shared_shingles_are_put_in_order_by_slices():
    rng = np.random.default_rng(1)
    rows, pool, seen = [], rng.integers(0, 1 << 48, 400_000, dtype=np.uint64), {}
    for _ in range(30):
        keys = np.sort(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        low = pool[rng.integers(0, len(pool), 30_000)]
        for key, h in zip(np.repeat(keys, 300).tolist(), low.tolist(), strict=True):
            seen.setdefault(h, set()).add(key)
        none = np.zeros(0, np.int64).tobytes()
        rows.append((5, keys.tobytes(), np.full(100, 300, np.uint32).tobytes(), ngram_join._pack48(low), none, none, none, none))
    names = ["fragment", "keys", "counts", "hashes", "doc_ids", "doc_texts", "doc_keys", "doc_sizes"]
    table = pa.table([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=names)
    tracemalloc.start()
    out = ngram_join._shared(5, 32)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 900_000  # bytes for a shingle
    got = {(h, key) for key_, n, items in zip(*(out.column(c).to_pylist() for c in ("keys", "counts", "items")), strict=True)
           for key, h in zip(np.repeat(np.frombuffer(key_, np.uint64), np.frombuffer(n, np.uint32)).tolist(), (np.frombuffer(items, np.uint64) & np.uint64((1 << 48) - 1)).tolist(), strict=True)}
    assert got == {(h, key) for h, keys in seen.items() if len(keys) > 1 for key in keys}


def test_metric_report_reads_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    runs = spark.range(50).selectExpr("id % 2 AS g", "id AS files_read", "id % 3 = 0 AS correct", "id % 2 = 0 AS completed").mapInArrow(count, "g long, files_read long, correct boolean, completed boolean")
    got = {(r["g"], r["completed"], r["metric"]): (r["count"], r["median"]) for r in quality.metric_report(runs, ["g", "completed"]).collect()}
    assert seen.value == 50
    assert got[0, True, "files_read"] == (25, 24.0) and got[1, False, "completed"] == (25, 0.0) and len(got) == 6


def test_search_reads_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    evidence = spark.range(40).selectExpr("id AS evidence_id", "concat('alpha beta ', id) AS content", "array('src') AS exact_terms")
    evidence = evidence.mapInArrow(count, "evidence_id long, content string, exact_terms array<string>")
    queries = spark.createDataFrame([(1, '"alpha beta" 7'), (2, "src or 9")], "query_id long, query string")
    got = {(r["query_id"], r["evidence_id"]): r["exact_match"] for r in index.search(queries, evidence, limit=50).collect()}
    assert got == {(1, 7): False} | {(2, i): True for i in range(40)}
    assert seen.value <= 80  # texts once, exact terms once


def test_postings_arise_where_the_text_is(spark):
    rows = spark.createDataFrame([(1, "b a b"), (1, "a"), (2, None), (3, "c")], "evidence_id long, content string")
    made = index.postings(index.text_entries(rows))
    assert sorted(map(tuple, made.select("lexeme", "evidence_id", "positions").collect())) == [("a", 1, [0, 1]), ("b", 1, [0, 2]), ("c", 3, [0])]
    assert "hashpartitioning(lexeme" not in made._jdf.queryExecution().executedPlan().toString()
