"""Policy with ids told anew, and evidence matching, on small fixtures."""

import itertools
import random

import pytest

from quarrylight.functions.content import REDACTED
from quarrylight.operators import evaluation, matching, policy

ITEM = "query_id long, item_id string, kind string, content string, authorization string, persist string, transfer string, supports array<string>, provenance array<string>"
LINK = "query_id long, relation_id string, from_id string, to_id string, path array<string>, supports array<string>, provenance array<string>"


def item(i, kind="evidence", content="plain", auth="allow", persist=None, transfer=None, supports=None, provenance=None, query=1):
    return (query, i, kind, content, auth, persist, transfer, supports, provenance)


def states(spark, rows, **how):
    out, _ = policy.apply_policy(spark.createDataFrame(rows, ITEM), **how)
    return {(r["query_id"], r["item_id"]): r for r in out.collect()}


def test_each_item_on_its_own(spark):
    rows = [
        item("a"), item("b", auth="deny"), item("c", auth=None), item("d", "fact", auth="redact"), item("e", auth="redact"), item("f", transfer="deny"), item("g", "entity", "password: hunter2"),
        item("h", content="password: hunter2"), item("i", content="\x00"), item("j", content=None, auth="redact"), item("k", "fact", None), item("l", persist="deny"),
    ]
    got = {k[1]: r["reason"] for k, r in states(spark, rows).items()}
    assert got == {"a": None, "b": "authorization_deny", "c": "authorization_deny", "d": "authorization_redact", "e": None, "f": "transfer_policy", "g": "inspection", "h": "transfer_policy", "i": "invalid", "j": None, "k": None, "l": None}
    told = states(spark, rows)
    assert told[1, "e"]["redacted"] and told[1, "e"]["content"] == REDACTED and told[1, "e"]["output_id"] != "e" and told[1, "a"]["output_id"] == "a" and not told[1, "j"]["redacted"]
    local = {k[1]: (r["reason"], r["content"]) for k, r in states(spark, rows, mode="local").items()}
    assert local["h"] == (None, REDACTED) and local["l"] == ("persistence", None) and local["f"] == (None, "plain") and local["g"][0] == "inspection"
    assert {r["reason"] for k, r in states(spark, [item("a"), item("d", "fact")], layer="redact").items()} == {None, "transfer_policy"}
    assert states(spark, []) == {}
    with pytest.raises(ValueError, match="modes"):
        policy.admit(spark.createDataFrame(rows, ITEM), mode="both")


def test_what_leans_on_what_went_goes(spark):
    hidden = states(spark, [item("e", auth="redact")])[1, "e"]["output_id"]
    rows = [
        item("bad", auth="deny"), item("one", supports=["bad"]), item("two", supports=["one"]), item("three", provenance=["two", "elsewhere"]), item("unknown", supports=["elsewhere"]), item("self", supports=["self"]),
        item("e", auth="redact"), item("by_id", supports=["e"]), item("by_output", provenance=[hidden], supports=[hidden]), item("x", supports=["y"]), item("y", supports=["x"]), item("one", query=2), item("free", supports=["one"], query=2),
        item("itself", provenance=["itself"]), item("none", supports=[], provenance=None),
    ]
    got = {k: r["reason"] for k, r in states(spark, rows).items()}
    out = {"one", "two", "three", "unknown", "self"}
    assert {k for k, v in got.items() if v == "support"} == {(1, i) for i in out} and got[1, "bad"] == "authorization_deny"
    assert all(v is None for k, v in got.items() if k[1] not in out | {"bad"} or k[0] == 2)


def test_cascade_against_a_loop_over_random_items(spark):
    rng = random.Random(7)
    ids = [f"i{k}" for k in range(60)]
    rows = [item(i, auth="deny" if rng.random() < 0.04 else "allow", supports=rng.sample(ids, rng.choice([0, 0, 1])), provenance=rng.sample(ids, rng.choice([0, 0, 1]))) for i in ids]
    gone = {r[1] for r in rows if r[4] == "deny"} | {r[1] for r in rows if r[1] in r[7]}
    while more := {r[1] for r in rows if r[1] not in gone and gone & {*r[7], *r[8]}}:
        gone |= more
    assert {k[1] for k, r in states(spark, rows).items() if r["reason"]} == gone


def test_relations_and_the_authorised_projection(spark):
    rows = [item("a"), item("b", transfer="redact"), item("c", transfer="deny"), item("d", supports=["a", "b"]), item("n", supports=["c"])]
    links = [
        (1, "ok", "a", "b", ["a", "b"], ["d", "b"], ["elsewhere"]), (1, "end", "a", "c", ["a"], None, None), (1, "path", "a", "b", ["a", "c", "b"], ["c"], None), (1, "support", "a", "b", None, ["elsewhere"], None),
        (1, "cited", "a", "b", None, None, ["c"]), (1, "no", None, "b", None, None, None), (2, "other", "a", "b", None, None, None),
    ]
    items, relations = spark.createDataFrame(rows, ITEM), spark.createDataFrame(links, LINK)
    _, out = policy.apply_policy(items, relations)
    got = {r["relation_id"]: r for r in out.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"ok": None, "end": "endpoint", "path": "path", "support": "support", "cited": "support", "no": "endpoint", "other": "endpoint"}
    b = got["ok"]["to_id"]
    assert b.startswith("evidence-") and got["ok"]["path"] == ["a", b] and got["ok"]["supports"] == ["d", b]
    more = items.selectExpr("*", "0.5D AS relevance", "3 AS rank", "array('evidence') AS aspects").drop("authorization")
    shown, kept = policy.authorized_projection(more, relations.selectExpr("*", "0.5D AS score", "1 AS rank"))
    told = {r["item_id"]: r for r in shown.collect()}
    assert set(told) == {"a", b, "d"} and told["d"]["supports"] == ["a", b] and told[b]["tokens"] == 3 and told[b]["redundancy_key"] == b and told["a"]["supports"] == []
    assert [(r["relation_id"], r["rank"]) for r in kept.collect()] == [("ok", 1)]


GLOBS = {
    "src/a.java": ["src/a.java"], "src\\a.java": ["src/a.java"], "src/*.java": ["src/a.java", "src/b.java", "src/.java", "src/[a.java", "src/(.java", "src/é.java"], "*/a.java": ["src/a.java", "lib/a.java"], "*": ["a.java"], "src/?.java": ["src/a.java", "src/b.java", "src/(.java", "src/é.java"],
    "src/[a-b].java": ["src/a.java", "src/b.java"], "src/[^a].java": ["src/b.java", "src/(.java", "src/é.java"], "[b-a].java": [], "src/[a.java": ["src/[a.java"], "src/[-a].java": [], "src/(.java": ["src/(.java"], "src/é*": ["src/é.java"], "s.c/a.java": [], "lib/x/*/z": ["lib/x/y/z"], "": [],
}
PATHS = ["src/a.java", "src/b.java", "src/.java", "lib/a.java", "a.java", "src/[a.java", "src/(.java", "src/é.java", "lib/x/y/z", "lib/x/z", None]


def test_globs_mean_their_paths(spark):
    patterns = spark.createDataFrame([("b", g) for g in GLOBS] + [("b", None), ("other", "*")], "bundle_id string, pattern string")
    paths = spark.createDataFrame([("b", p) for p in PATHS], "bundle_id string, path string")
    got = {}
    for r in matching.matching_paths(patterns, paths).collect():
        assert r["exact"] == (r["pattern"] == r["path"])
        got.setdefault(r["pattern"], []).append(r["path"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in GLOBS.items() if v}


def test_ranges_meet_once(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for k in range(n):
            a = rng.choice([rng.randrange(1, 100), rng.randrange(1, 100_000), 2**31 - 1 - rng.randrange(50)])
            out.append((k, a, a + rng.choice([0, 1, 7, 8, 63, 5000, 2**30])))
        return out

    x, u = some(80), some(80)
    wanted, units = (spark.createDataFrame([(1, *r) for r in rows], f"k int, {n} int, start long, end long") for rows, n in ((x, "x"), (u, "u")))
    got = sorted((r["x"], r["u"]) for r in matching.overlapping_lines(wanted, units, ["k"]).collect())
    assert got == sorted((a[0], b[0]) for a, b in itertools.product(x, u) if a[1] <= b[2] and b[1] <= a[2])


def test_scores_and_matchings(spark):
    x = [
        ("b", 1, 1, "src/a.java", None, None, None, None), ("b", 1, 2, "src/*.java", " Run ", None, 5, 0), ("b", 1, 3, None, None, "SELECT", None, None), ("b", 1, 4, "", None, None, None, None), ("b", 1, 5, "src/b.java", None, None, 90, None),
        ("b", 2, 1, None, "gone", None, None, None), ("none", 3, 1, None, None, None, None, None),
    ]
    u = [("b", "u1", "src/a.java", "run", None, "x", 1, 5), ("b", "u2", "src/b.java", None, "prerun", None, None, None), ("b", "u3", "src/a.java", None, None, "select 1; run", 6, 2), ("b", "u0", None, None, None, "", 0, 0)]
    expected = spark.createDataFrame(x, "bundle_id string, case_id int, expected_id int, path string, member string, attribute string, start_line int, end_line int")
    units = spark.createDataFrame(u, "bundle_id string, evidence_id string, path string, member string, method string, content string, start_line int, end_line int")
    scored = matching.scored_matches(expected, units)
    got = sorted((r["case_id"], r["expected_id"], r["evidence_id"], r["score"]) for r in scored.collect())
    assert got == [(1, 1, "u1", 110), (1, 1, "u3", 110), (1, 2, "u1", 90), (1, 2, "u2", 90), (1, 3, "u3", 10), (1, 4, "u0", 10), (1, 4, "u1", 10), (1, 4, "u2", 10), (1, 4, "u3", 10), (1, 5, "u2", 120)]
    assert sorted((r["expected_id"], r["evidence_id"], r["reused"]) for r in evaluation.greedy_match(scored).collect()) == [(1, "u1", False), (2, "u2", False), (3, "u3", False), (4, "u0", False), (5, "u2", True)]
    most = evaluation.bipartite_match(scored).collect()
    assert len(most) == 4 == len({r["evidence_id"] for r in most})
    assert matching.scored_matches(expected.limit(0), units).count() == 0 == matching.scored_matches(expected, units.limit(0)).count()


def test_matching_never_shuffles_single_pairs(spark):
    """Of 3,000 units alike, in several rows, an expectation sends on only the first ids that fit."""
    units = spark.range(3000).selectExpr("'b' AS bundle_id", "id AS evidence_id", "'p.java' AS path", "'f' AS member", "cast(null AS string) AS method", "'text' AS content", "cast(id % 7 AS int) AS start_line", "cast(id % 7 + 1 AS int) AS end_line")
    x = spark.sql("SELECT 'b' bundle_id, 'c' case_id, e expected_id, if(e < 2, 'p.java', null) path, if(e = 3, 'F', null) member, cast(null AS string) attribute, if(e % 2 = 1, 6, 0) start_line, if(e % 2 = 1, 6, 0) end_line FROM VALUES (0L), (1L), (2L), (3L) AS t(e)")
    out = matching.scored_matches(x, units)
    got = {}
    for r in out.orderBy("expected_id", "place").collect():
        got.setdefault(r["expected_id"], []).append((r["evidence_id"], r["score"]))
    lined = [i for i in range(3000) if i % 7 in (0, 5, 6)][:4]
    assert got == {0: [(i, 110) for i in range(4)], 1: [(i, 120) for i in lined], 2: [(i, 10) for i in range(4)], 3: [(i, 40) for i in lined]}
    assert "windowspecdefinition(case_id" not in out._jdf.queryExecution().optimizedPlan().toString()
