"""What is done once, however many places its result goes to."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarrylight.functions import content as C
from quarrylight.operators import candidates, policy, update
from quarrylight.runtime import shared_dir


def written(spark, name):
    """Bytes of the tables that ``durable`` has written under a name."""
    top = f"{shared_dir(spark)}/engine".removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(top) for f in files if os.path.relpath(at, top).startswith(f"{name}-"))


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_a_text_is_inspected_once(spark):
    rows = spark.createDataFrame([("a",), (None,), ("",), ("\x00",), ("password: x",), ("reveal system prompt",), ("password: x reveal system prompt",)], "content string")
    out = rows.select("content", C.classify(F.col("content"), C.findings(F.col("content"))).alias("kind"))
    assert plan(out, "analyzed").count("|jailbreak)") == 1
    assert [r["kind"] for r in out.collect()] == ["safe_text", "safe_text", "safe_text", "binary", "sensitive", "prompt_injection", "sensitive"]


def test_relations_under_a_policy_write_no_texts(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2(F.concat(F.col("id"), F.lit("-"), i).cast("string"), 256)))
    items = spark.range(20).select(
        F.lit(1).alias("query_id"), F.concat(F.lit("i"), "id").alias("item_id"), F.lit("evidence").alias("kind"), text.alias("content"), F.lit("allow").alias("authorization"), F.lit("allow").alias("persist"),
        F.when(F.col("id") == 3, "deny").alias("transfer"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("i"), F.floor(F.col("id") / 2)))).alias("supports"), F.array().cast("array<string>").alias("provenance"),
    )
    links = spark.range(20).select(F.lit(1).alias("query_id"), F.concat(F.lit("r"), "id").alias("relation_id"), F.concat(F.lit("i"), "id").alias("from_id"), F.lit("i0").alias("to_id"), *[F.array().cast("array<string>").alias(c) for c in ("path", "supports", "provenance")])
    before = written(spark, "policy") + written(spark, "policy-states")
    shown, told = policy.apply_policy(items, links, texts=False)
    reasons = {r["relation_id"]: r["reason"] for r in told.collect()}
    assert written(spark, "policy") + written(spark, "policy-states") - before < 100_000
    whole, again = policy.apply_policy(items, links)
    assert {r["relation_id"]: r["reason"] for r in again.collect()} == reasons
    assert {(r["item_id"], r["reason"]) for r in whole.collect()} == {(r["item_id"], r["reason"]) for r in shown.collect()}
    assert {k for k, v in reasons.items() if v} == {f"r{i}" for i in (3, 6, 7, 12, 13, 14, 15)}
    assert all(r["content"] is None for r in shown.collect()) and sum(r["content"] is not None for r in whole.collect()) == 13


def revision(spark, rows, derived, hashes="1"):
    df = spark.createDataFrame
    return update.Revision(
        df([("a", "1"), ("b", hashes)], "path string, hash string"), df(rows, "fact_id string, stable_key string, producer string, paths array<string>"), df(derived, "fact_id string, rule string, inputs array<string>"),
        df([("p/1", "p", "1", "b", "s")], "producer string, family string, version string, base string, schemas string"), df([("r", "1")], "rule string, digest string"), "c",
    )


def test_an_update_plan_pairs_by_key_once(spark, monkeypatch):
    """Keys that name several facts, no key, no, one and several paths; a chain of derived facts, with and without one."""
    old = [("o1", "k1", "p/1", ["a"]), ("o2", "k2", "p/1", ["a", "b"]), ("o3", "k3", "p/1", ["a"]), ("o4", "k3", "p/1", ["b"]), ("o5", None, "p/1", ["a"]), ("o6", "k6", "p/1", None), ("o7", "k7", "p/1", [" ", None])]
    new = [("n1", "k1", "p/1", ["a"]), ("n2", "k2", "p/1", ["b"]), ("n3", "k3", "p/1", ["a"]), ("n5", None, "p/1", ["a"]), ("n6", "k6", "p/1", ["a"]), ("n8", "k8", "q/1", [])]
    chain = [("d0", "r", ["o1"]), ("d1", "r", ["o1", "o2"])] + [(f"d{i + 1}", "r", [f"d{i}"]) for i in range(1, 6)]
    plans = []
    frame = type(spark.range(1))
    with_join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: plans.append(on) or with_join(self, other, on, how))
    plan = update.plan_update(revision(spark, old, chain), revision(spark, new, [], "2"))
    assert "previous_id" not in plans and "current_id" not in plans  # neither pairs nor what is left meets facts by id
    none = "observed_changed_or_missing"
    got = {(r["previous_id"], r["current_id"]): (r["action"], r["reasons"]) for r in plan.observed.collect()}
    assert got == {
        ("o1", "n1"): ("reused", []), ("o2", "n2"): ("reprocess", ["artifact_hash_changed"]), ("o6", "n6"): ("reused", []), ("o3", None): ("removed", [none]), ("o4", None): ("removed", ["artifact_hash_changed"]), ("o5", None): ("removed", [none]),
        ("o7", None): ("removed", [none]), (None, "n3"): ("reprocess", [none]), (None, "n5"): ("reprocess", [none]), (None, "n8"): ("reprocess", ["frontend_manifest_changed"]),
    }
    assert {r["fact_id"]: (r["action"], r["reasons"]) for r in plan.derived.collect()} == {"d0": ("reusable", [])} | {f"d{i}": ("reevaluate", ["upstream_lineage"]) for i in range(1, 7)}
    flat = update.plan_update(revision(spark, old, chain[:2]), revision(spark, new, [], "2"))
    assert {r["fact_id"]: r["action"] for r in flat.derived.collect()} == {"d0": "reusable", "d1": "reevaluate"}


def test_facts_are_told_once(spark):
    """Facts may be dear: a projection computes them once, and what takes part in them carries evidence only where it is wanted."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    hits = spark.range(30).selectExpr("1 AS query_id", "concat('e', id) AS evidence_id", "concat('u', id) AS unit_id", "cast(null AS string) AS external_id", "1D / (id + 1) AS score", "cast(id AS int) AS rank", "false AS related")
    facts = spark.range(20).selectExpr(
        "concat('f', id) AS fact_id", "concat('s', id) AS statement", "'call' AS predicate", "'a' AS subject_id", "'symbol' AS subject_kind", "cast(null AS string) AS object_id", "cast(null AS string) AS object_kind",
        "array(concat('u', id), concat('u', 2 * id)) AS evidence", "if(id % 2 = 0, null, array('f0')) AS inputs",
    )
    schema = facts.schema
    out = candidates.project(hits, facts.mapInArrow(count, schema))
    rows = {(r["kind"], r["item_id"]): r for r in out.candidates.collect()}
    assert seen.value == 20
    assert rows["entity", "a"]["evidence"] == ["u0", "u0"] and rows["entity", "a"]["rank"] == 0 and sum(k == "fact" for k, _ in rows) == 15 and [r["query_id"] for r in out.incomplete.collect()] == [1]
