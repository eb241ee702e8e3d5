"""Relation expansion: ranks without a sort of single references."""

from quarrylight.operators import expansion


def test_ranks_and_repeats(spark):
    seeds = spark.createDataFrame([(1, 10, 0.9, "a"), (1, 10, 0.9, "b"), (1, 11, 0.5, "a")], "query_id int, evidence_id int, score double, entity string")
    edges = spark.createDataFrame([("ab", "a", "b", "t"), ("ac", "a", "c", "t")], "edge_id string, from_id string, to_id string, type string")
    refs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4), ("z", 9)], "entity string, evidence_id int")
    out = expansion.expand(seeds, edges, refs, budget=12)
    got = sorted((r["rank"], r["seed_evidence"], r["anchor"], r["edge_id"], r["evidence_id"], r["counts"]) for r in out.collect())
    # a pays for 2 edges and 3 references, b for 1 and 2, of the last seed's 3 references 2 are left
    assert got == [
        (1, 10, "a", "ab", 2, True), (2, 10, "a", "ab", 3, True), (3, 10, "a", "ac", 4, True), (4, 10, "b", "ab", 1, True), (5, 10, "b", "ab", 2, False),
        (6, 11, "a", "ab", 2, True), (7, 11, "a", "ab", 3, True),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("position" not in line or "query_id" not in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window"))


def test_composed_pairs_are_not_shuffled(spark):
    """Pairs of order and supplier arise behind the last exchange."""
    from conftest import SMALL

    from quarrylight.plans.queries import QUERIES

    plan = QUERIES["dependency_composition"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate", 1)[0] and "Exchange" in plan.split("Generate", 1)[1]


def test_the_best_without_all_references(spark):
    """The same rows as all references give, also where edges are walked twice, and few of them are met."""
    import random

    rnd = random.Random(5)
    edges = [(f"{a}>{b}", a, b, "t") for a, b in {(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(200)}]
    refs = [(f"n{rnd.randrange(40)}", rnd.randrange(3_000)) for _ in range(12_000)] + [("n1", None)]
    fused = [(q, e, round(rnd.random() / 20, 3)) for q in (1, 2, None) for e in rnd.sample(range(3_000), 6)] + [(3, 1, 0.5)]
    seeds = [(q, e, s, f"n{rnd.randrange(40)}") for q, e, s in fused for _ in range(4) if q != 3] + [(3, 1, 0.5, "n77")]
    fused = spark.createDataFrame(fused, "query_id int, evidence_id int, score double")
    seeds = spark.createDataFrame(seeds, "query_id int, evidence_id int, score double, entity string")
    edges = spark.createDataFrame(edges, "edge_id string, from_id string, to_id string, type string")
    refs = spark.createDataFrame(refs, "entity string, evidence_id int")
    told = lambda df: sorted((str(r["query_id"]), r["rank"], r["evidence_id"], round(r["score"], 9), r["relations"]) for r in df.collect())
    for budget, limit in ((10**7, 10), (10**7, 5_000), (700, 10)):
        every = expansion.expand(seeds, edges, refs, budget)
        assert told(expansion.expand_and_fuse(fused, seeds, edges, refs, budget, limit=limit)) == told(expansion.fuse_relations(fused, every, limit=limit))


def test_wide_expansion_meets_few_references(spark):
    """Evidence that can't be among the best isn't ranked: less is scored than a query's edges lead to."""
    from conftest import SMALL

    from quarrylight.plans import queries

    fused, seeds, references = queries.expansion_inputs(spark, SMALL)
    edges = queries.supply_edges(spark, SMALL)
    scored = []
    whole = expansion.fuse_relations
    expansion.fuse_relations = lambda fused, expanded, *more: scored.append(expanded) or whole(fused, expanded, *more)
    try:
        expansion.expand_and_fuse(fused, seeds, edges, references, 10_000_000, limit=2)
    finally:
        expansion.fuse_relations = whole
    assert 0 < 2 * scored[0].count() < expansion.expand(seeds, edges, references, 10_000_000).count()


def test_composition_of_odd_ids(spark):
    """Ids of any size or none; repeated edges; no partitions merged before pairs arise."""
    from quarrylight.operators.graph import composition

    big = 2**62 + 5
    first = [(1, 7), (1, 7), (1, 8), (-5, 7), (big, 8), (20_000, 8), (None, 7), (3, None), (4, 99)]
    second = [(7, 1), (7, 1), (7, -big), (8, 1), (8, None), (None, 6), (98, 2)]
    f, g = (spark.createDataFrame(r, c) for r, c in ((first, "src long, via long"), (second, "via long, dst long")))
    want = {}
    for s, v in set(first):
        for w, d in set(second):
            if v == w and v is not None:
                want[s, d] = want.get((s, d), 0) + 1
    made = composition(f, g, 10 * 50_000)
    assert {(r["src"], r["dst"]): r["paths"] for r in made.collect()} == want
    assert "hashpartitioning(src_block" in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
