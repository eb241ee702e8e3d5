"""Candidate projection, quality of variants and the metric report on small fixtures."""

import math
import random
import statistics

import pytest

from quarrylight.operators import candidates, quality

HIT = "query_id int, evidence_id string, unit_id string, external_id string, score double, rank int, related boolean"
FACT = "fact_id string, statement string, predicate string, subject_id string, subject_kind string, object_id string, object_kind string, evidence array<string>, inputs array<string>"
HITS = [
    (1, "e1", "u1", "x1", 0.9, 2, False), (1, "e2", "u2", None, 0.5, 1, True), (1, "e3", "u1", None, 0.2, 9, True), (1, "e4", "x1", None, 3.0, 4, None), (2, "e2", "u2", "x2", -1.0, 3, False), (3, "e9", None, "x9", 0.5, 1, False),
]
FACTS = [
    ("f1", "s1", "dependency", "a", "artifact", "b", "symbol", ["x1", "u2"], None), ("f2", "s2", "call", "b", "symbol", "b", "symbol", ["u2"], ["f1", "f9"]), ("f3", "s3", "call", "c", "named_element", None, None, ["u2", "gone"], None),
    ("f4", "s4", "call", "d", None, "e", "other", ["gone"], None), ("f5", "s2", "call", "b", "symbol", "b", "symbol", ["u2"], ["f1", "f9"]), ("f6", "s6", "call", "z", "symbol", None, None, [], None), ("f7", "s7", "call", "z", "symbol", None, None, None, None),
]


def test_candidates_of_all_kinds(spark):
    out = candidates.project(spark.createDataFrame(HITS, HIT), spark.createDataFrame(FACTS, FACT))
    rows = {(r["query_id"], r["kind"], r["item_id"]): r for r in out.candidates.collect()}
    one = {k[1:]: r for k, r in rows.items() if k[0] == 1}
    facts = {tuple(r["evidence"]): r for k, r in one.items() if k[0] == "fact"}
    assert {k[1] for k in one if k[0] == "evidence"} == {"u1", "u2", "x1"} and {k[1] for k in one if k[0] == "entity"} == {"a", "b"}
    assert set(facts) == {("u1", "u2"), ("u2",)}  # x1 is u1's external id before it is a unit of its own; f2 and f5 are one
    u1, u2, x1 = (one["evidence", u] for u in ("u1", "u2", "x1"))
    assert (u1["relevance"], u1["rank"], u1["aspects"]) == (0.9, 2, ["evidence", "source", "relation"]) and x1["relevance"] == 1.0 and x1["aspects"] == ["evidence", "source"]
    told = facts["u1", "u2"]
    assert (told["relevance"], told["rank"], told["aspects"], told["origin"]) == (0.9, 2, ["dependency", "evidence", "relation"], "observed") and facts[("u2",)]["origin"] == "derived"
    assert one["entity", "a"]["aspects"][0] == "artifact" and (one["entity", "b"]["rank"], one["entity", "b"]["origin"]) == (2, "observed")
    order = sorted(one.values(), key=lambda r: (r["rank"], r["kind"], r["item_id"]))
    assert [r["place"] for r in order] == list(range(1, len(one) + 1)) and u2["rank"] == 1
    two = {k[1:] for k in rows if k[0] == 2}
    assert ("evidence", "u2") in two and len([k for k in two if k[0] == "fact"]) == 1 and rows[2, "evidence", "u2"]["relevance"] == 0.01 and not any(k[0] == 3 for k in rows)
    links = {(r["query_id"], r["from_id"], r["to_id"]): r for r in out.relations.collect()}
    assert set(links) == {(1, "a", "b")} and links[1, "a", "b"]["supports"] == [told["item_id"], "u1", "u2"] and links[1, "a", "b"]["path"] == ["a", "b"]
    assert sorted(r["query_id"] for r in out.incomplete.collect()) == [1, 2]


def test_conflicts_and_nothing(spark):
    bad = [(1, "e1", "u1", "x1", 0.1, 1, None), (1, "e2", "u1", "x2", 0.1, 1, None), (1, "e3", "u3", "x3", 0.1, 1, None), (1, "e3", "u4", "x3", 0.1, 1, None), (2, "e1", "u9", "x1", 0.1, 1, None)]
    got = sorted(tuple(r) for r in candidates.retrieval_conflicts(spark.createDataFrame(bad, HIT)).collect())
    assert got == [(1, "e3", "units_of_evidence"), (1, "u1", "external_ids"), (1, "x3", "units_of_external_id")]
    out = candidates.project(spark.createDataFrame([], HIT), spark.createDataFrame(FACTS, FACT))
    assert out.candidates.count() == out.relations.count() == out.incomplete.count() == 0


CASE = "case_id int, reference_claims array<string>, expected_evidence array<string>, expected_gaps array<string>, acceptable array<struct<claim_id:string,evidence_ids:array<string>>>, abstention_expected boolean"
RESULT = "case_id int, variant string, claims array<string>, evidence array<string>, gaps array<string>, citations array<struct<claim_id:string,evidence_id:string>>, status string, conclusion string"


def test_quality_by_ids(spark):
    cases = [(1, ["c1", "c2"], ["e1", "e2", None], ["g1"], [("c1", ["e1"]), ("c2", ["e2", "e3"])], False), (2, None, [], None, None, True), (3, ["c"], ["e"], [], [], None)]
    results = [
        (1, "a", ["c2", "c1", "c1"], ["e1", "e3", None], ["g2"], [("c1", "e1"), ("c1", "e1"), ("c1", "e3"), ("c2", "e3"), ("c9", "e1"), ("c2", "e2"), (None, None)], "completed", "passed"), (1, "b", ["c1", "c9"], [], ["g1"], None, "limited", "passed"),
        (2, "a", None, None, None, [], "completed", "abstained"), (3, "a", ["c"], ["e"], None, None, "completed", "abstained"), (3, "b", ["c"], ["e"], None, None, None, None), (9, "a", [], [], [], [], "completed", "passed"),
    ]
    got = {(r["case_id"], r["variant"]): r for r in quality.derive_quality(spark.createDataFrame(cases, CASE), spark.createDataFrame(results, RESULT)).collect()}
    assert len(got) == 5
    a = got[1, "a"]
    assert a["correct"] and a["completed"] and a["abstention_appropriate"] and (a["expected"], a["retrieved"], a["relevant"]) == (3, 2, 1) and (a["citations_total"], a["citations_valid"]) == (7, 3) and a["gap_recall"] == 0
    b = got[1, "b"]
    assert not b["correct"] and not b["completed"] and b["evidence_precision"] is None and b["evidence_recall"] == 0 and b["citation_rate"] is None and b["gap_recall"] == 1
    assert got[2, "a"]["completed"] and got[2, "a"]["correct"] and got[2, "a"]["evidence_recall"] is None and got[2, "a"]["abstention_appropriate"]
    assert not got[3, "a"]["completed"] and not got[3, "a"]["abstention_appropriate"] and not got[3, "b"]["abstention_appropriate"]


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_report_has_exact_medians(spark, accuracy):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 9), float(rng.randrange(4))]), rng.random() < 0.5, None) for g in ["x"] * 700 + [None] * 301 + ["one"] for _ in range(1)]
    rows += [("ties", 2.0, True, None)] * 50 + [("two", 1.0, None, None), ("two", 4.0, None, None)]
    df = spark.createDataFrame(rows, "g string, duration double, correct boolean, actual_cost double").repartition(7)
    got = {(r["g"], r["metric"]): r for r in quality.metric_report(df, ["g"], accuracy=accuracy).collect()}
    for (g, metric), at in {(g, m): i for g in ("x", None, "ties", "two", "one") for m, i in (("duration", 1), ("correct", 2))}.items():
        values = [float(r[at]) for r in rows if r[0] == g and r[at] is not None and math.isfinite(r[at])]
        if not values:
            assert (g, metric) not in got
            continue
        r = got[g, metric]
        assert r["count"] == len(values) and r["median"] == statistics.median(values) and (r["min"], r["max"]) == (min(values), max(values))
        assert r["mean"] == pytest.approx(statistics.fmean(values)) and r["stddev"] == pytest.approx(statistics.pstdev(values), abs=1e-9)
    assert not any(m == "actual_cost" for _, m in got) and quality.metric_report(df.limit(0), ["g"]).count() == 0
    with pytest.raises(ValueError, match="none of the metrics"):
        quality.metric_rows(df.select("g"), ["g"])
