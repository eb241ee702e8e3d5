"""Relation expansion of fused candidates under one budget that a query shares.

Seeds spend the budget one after the other, in a global order: a seed pays for its
edges first, then for each reference of what they lead to. So all seeds before the
one that the budget ends in are whole, and that one gets what is left: a prefix sum
of the seeds' whole costs says for each how many edges and references it has, and
no seed waits for another.

Where only the best of a query are wanted, ``expand_and_fuse`` needn't meet all of
its references: an edge's references add at most 1 / (k + the rank of its first), so
evidence that only late edges lead to is let go where all of them together can't lift
it to what as many others as are wanted have for certain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.relations import one_hop
from quarrylight.operators.retrieval import RRF_K, ranked
from quarrylight.runtime import discard, durable


def expand(seeds: DataFrame, edges: DataFrame, references: DataFrame, budget: int = 100, fanout: int = 25, direction: str = "both") -> DataFrame:
    """References that the seeds' edges lead to, within ``budget`` for each query.

    ``seeds``: query_id, evidence_id, score, entity (best score first, then by
    evidence and entity); ``edges`` as for ``one_hop``; ``references``: entity,
    evidence_id. Returns query_id, seed_evidence, anchor, edge_id, evidence_id,
    rank (1, 2, ... through all seeds of the query) and counts: false where the
    same seed, edge and evidence came before, which takes a rank but adds nothing.

    Seeds without an edge cost nothing. Null entities have no edges and no
    references; repeated references are one, repeated seeds are seeds of their own.
    """
    walked, own = _walks(seeds, edges, references, budget, fanout, direction)
    return _ranks(_reached(walked.filter("ways = 1"), own), _reached(walked.filter("ways > 1"), own))


def _walks(seeds: DataFrame, edges: DataFrame, references: DataFrame, budget: int, fanout: int, direction: str) -> tuple[DataFrame, DataFrame]:
    """What seeds can pay for, and the references in their places, as files.

    A row for each seed and edge with a reference: target (what the edge leads to),
    before and ahead (references that count before this seed, and of this seed before
    this edge), kept (of the seed) and ways (how often this evidence walks this edge);
    and entity, evidence_id, place (1, 2, ... in the entity).
    """
    if budget < 1:
        raise ValueError("the budget is at least 1")
    seeds = durable(seeds.select("query_id", "evidence_id", "score", "entity"), "seeds")
    anchors = durable(seeds.select(F.col("entity").alias("anchor")).distinct(), "anchors")
    hits = one_hop(anchors, edges, direction, fanout)
    hits = hits.withColumn("target", F.when(F.col("from_id") == F.col("anchor"), F.col("to_id")).otherwise(F.col("from_id"))).select("anchor", "edge_id", "position", "target")
    hits = durable(hits, "hops")
    led = durable(hits.select(F.col("target").alias("entity")).distinct(), "led")
    # more references of one entity than the budget has can't be reached
    place = F.row_number().over(Window.partitionBy("entity").orderBy("evidence_id"))
    own = references.select("entity", "evidence_id").join(led, "entity", "left_semi").repartition("entity").distinct()
    own = durable(own.withColumn("place", place).filter(F.col("place") <= budget), "references")
    sizes = own.groupBy(F.col("entity").alias("target")).agg(F.count("*").alias("references"))
    sized = hits.join(sizes, "target", "left").fillna(0, ["references"])
    # how many references an anchor's edges before this one have: single references needn't be sorted
    before = Window.partitionBy("anchor").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("ahead", F.coalesce(F.sum("references").over(before), F.lit(0)))
    work = sized.groupBy("anchor").agg(F.count("*").alias("edges"), F.sum("references").alias("references"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id", "entity")
    whole = order.rowsBetween(Window.unboundedPreceding, -1)
    cost = seeds.join(work.withColumnRenamed("anchor", "entity"), "entity", "left").fillna(0, ["edges", "references"])
    cost = cost.withColumns({"seed": F.row_number().over(order), "room": F.greatest(F.lit(0), budget - F.coalesce(F.sum(F.col("edges") + F.col("references")).over(whole), F.lit(0)))})
    cost = cost.withColumn("kept", F.least("references", F.greatest(F.lit(0), F.col("room") - F.col("edges"))))
    cost = cost.withColumn("before", F.coalesce(F.sum("kept").over(whole), F.lit(0))).filter("kept > 0")
    seeded = cost.select("query_id", F.col("evidence_id").alias("seed_evidence"), F.col("entity").alias("anchor"), "kept", "before")
    walked = seeded.join(sized.filter("references > 0").select("anchor", "edge_id", "target", "ahead"), "anchor").filter("ahead < kept")
    walked = durable(walked.withColumn("ways", F.count("*").over(Window.partitionBy("query_id", "seed_evidence", "edge_id"))), "walks")
    for done in (seeds, anchors, hits, led):
        discard(done)
    return walked, own


_RANK = "cast(before + ahead + place AS bigint)"


def _reached(walked: DataFrame, own: DataFrame) -> DataFrame:
    """Walks and the references that they reach."""
    return walked.join(own.withColumnRenamed("entity", "target"), "target").filter(F.col("ahead") + F.col("place") <= F.col("kept"))


def _ranks(once: DataFrame, more: DataFrame) -> DataFrame:
    """Ranks of what walks reach, and whether they count; ``more``: of edges walked twice or more."""
    out = ["query_id", "seed_evidence", "anchor", "edge_id", "evidence_id", F.expr(_RANK).alias("rank")]
    # only an edge that a seed's evidence walks more than once can lead to the same evidence again
    again = Window.partitionBy("query_id", "seed_evidence", "edge_id", "evidence_id").orderBy("rank")
    return once.select(*out).withColumn("counts", F.lit(True)).unionByName(more.select(*out).withColumn("counts", F.row_number().over(again) == 1))


def expand_and_fuse(
    fused: DataFrame, seeds: DataFrame, edges: DataFrame, references: DataFrame, budget: int = 100, fanout: int = 25, direction: str = "both", weight: float = 1.0, k: int = RRF_K, limit: int = 20,
) -> DataFrame:
    """``fuse_relations`` of ``expand``, with the same rows, that meets no references
    of which it is certain that they make none of the best ``limit``.

    The first references of a query and its fused candidates tell a score that
    ``limit`` of its evidence reach. Walks are put in order of the most that one can
    add; of the last of them, which together add less than that score, references
    aren't met. What the others lead to is summed up, and where that and the most
    that the last can add reach the score, met with all walks.
    """
    if weight <= 0 or k < 0:  # no bound falls with the rank
        return fuse_relations(fused, expand(seeds, edges, references, budget, fanout, direction), weight, k, limit)
    walked, own = _walks(seeds, edges, references, budget, fanout, direction)
    add = lambda rank: F.lit(weight) / (rank + k)
    known = fused.select("query_id", "evidence_id", F.col("score").cast("double").alias("part"), F.lit(0).alias("one"))
    # a score that ``limit`` of a query's evidence reach: by fused candidates and the first ranks alone
    depth = 20 * limit
    first = durable(walked.filter(F.col("before") + F.col("ahead") < depth), "first-walks")
    head = _reached(first, own.filter(F.col("place") <= depth)).withColumn("rank", F.expr(_RANK)).filter(F.col("rank") <= depth)
    head = head.groupBy("query_id", "evidence_id").agg(add(F.min("rank")).alias("part")).unionByName(known.drop("one"))
    head = ranked(head.groupBy("query_id", "evidence_id").agg(F.sum("part").alias("score")), F.desc("score"), limit=limit).filter(F.col("rank") == limit)
    floors = durable(head.select("query_id", (F.col("score") - 1e-9 * F.greatest(F.lit(1.0), F.abs("score"))).alias("floor")), "floors")  # sums are rounded
    # the most that a walk and all after it can add
    after = Window.partitionBy("query_id").orderBy(F.desc(F.col("before") + F.col("ahead")))
    tails = walked.withColumn("most", F.sum(add(F.col("before") + F.col("ahead") + 1)).over(after))
    tails = tails.join(floors.withColumnRenamed("query_id", "q"), F.col("query_id").eqNullSafe(F.col("q")), "left").drop("q")
    late = F.coalesce(F.col("most") < 0.9 * F.col("floor"), F.lit(False))
    tails = tails.withColumns({"late": late, "rest": F.coalesce(F.max(F.when(late, F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))})
    early = durable(tails.filter(~F.col("late")).drop("most", "late", "ways"), "early-walks")
    led = _reached(early, own).groupBy("query_id", "evidence_id").agg(F.sum(add(F.expr(_RANK))).alias("part"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    led = led.filter(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))).select("query_id", "evidence_id")
    wanted = durable(led.unionByName(known.select("query_id", "evidence_id")).distinct(), "wanted")
    # these with all that leads to them
    met = wanted.alias("x").join(own.alias("y"), F.col("x.evidence_id").eqNullSafe(F.col("y.evidence_id"))).select("x.query_id", "x.evidence_id", F.col("entity").alias("target"), "place")
    both = lambda some: some.alias("w").join(met.alias("m"), (F.col("w.target") == F.col("m.target")) & F.col("w.query_id").eqNullSafe(F.col("m.query_id"))).drop(F.col("m.query_id"), F.col("m.target")).filter(F.col("ahead") + F.col("place") <= F.col("kept"))
    return fuse_relations(fused, _ranks(both(walked.filter("ways = 1")), both(walked.filter("ways > 1"))), weight, k, limit)


def fuse_relations(fused: DataFrame, expanded: DataFrame, weight: float = 1.0, k: int = RRF_K, limit: int = 20) -> DataFrame:
    """Fused candidates with weight / (k + rank) added for every reference that
    counts: query_id, evidence_id, score, relations, rank.

    Evidence that only relations lead to becomes a candidate of its own. Weight 0:
    the candidates as they are.
    """
    parts = expanded.filter("counts").select("query_id", "evidence_id", (F.lit(weight) / (F.col("rank") + k)).alias("part"), F.lit(1).alias("one"))
    parts = parts if weight > 0 else parts.limit(0)
    every = fused.select("query_id", "evidence_id", F.col("score").cast("double").alias("part"), F.lit(0).alias("one")).unionByName(parts)
    out = every.groupBy("query_id", "evidence_id").agg(F.round(F.sum("part"), 12).alias("score"), F.sum("one").alias("relations"))
    return ranked(out, F.desc("score"), F.asc("evidence_id"), limit=limit)
