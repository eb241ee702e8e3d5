"""Entities, typed directed edges and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entities_of(facts: DataFrame) -> DataFrame:
    """One row per participant (scope, kind, id) with the facts that name it."""
    sides = F.array(F.struct(F.col("subject_kind").alias("kind"), F.col("subject_id").alias("id")), F.struct(F.col("object_kind").alias("kind"), F.col("object_id").alias("id")))
    rows = facts.select("scope", "fact_id", F.explode(sides).alias("p")).filter("p.id is not null")
    return rows.groupBy("scope", F.col("p.kind").alias("kind"), F.col("p.id").alias("id")).agg(F.count_distinct("fact_id").alias("facts"))


def relations_of(facts: DataFrame) -> DataFrame:
    """One row per (scope, subject, predicate, object) with its facts in order."""
    return facts.filter("object_id is not null").groupBy("scope", "subject_id", "predicate", "object_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))


def one_hop(anchors: DataFrame, edges: DataFrame, direction: str = "both", fanout: int = 25, hops: int = 1) -> DataFrame:
    """Edges that touch an anchor, at most ``fanout`` of each.

    ``anchors``: anchor; ``edges``: edge_id, from_id, to_id, type. Per anchor in
    the order from, to, type, id. No hop: no row; more than one is refused.
    """
    if direction not in ("outbound", "inbound", "both") or hops not in (0, 1):
        raise ValueError("directions are outbound, inbound, both; hops 0 or 1")
    if hops == 0:
        return anchors.join(edges.limit(0), F.lit(True)).select("anchor", "edge_id", "from_id", "to_id", "type", F.lit(0).alias("position"))
    sides = []
    if direction in ("outbound", "both"):
        sides.append(edges.withColumn("anchor", F.col("from_id")))
    if direction in ("inbound", "both"):
        sides.append(edges.withColumn("anchor", F.col("to_id")))
    touched = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1].filter("from_id <> to_id"))
    hits = touched.join(anchors.select("anchor").distinct(), "anchor", "left_semi")
    order = Window.partitionBy("anchor").orderBy("from_id", "to_id", "type", "edge_id")
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= fanout).select("anchor", "edge_id", "from_id", "to_id", "type", "position")


def relation_seeds(fused: DataFrame, fact_evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, evidence_id, entity): subject and object of facts that cite it."""
    cited = fused.select("query_id", "evidence_id", "score").join(fact_evidence, "evidence_id").join(facts.select("fact_id", "subject_id", "object_id"), "fact_id")
    out = cited.select("query_id", "evidence_id", "score", F.explode(F.array("subject_id", "object_id")).alias("entity"))
    return out.filter("entity is not null").distinct()


def relation_references(seeds: DataFrame, hops: DataFrame, fact_evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence of the other end of every edge that touches a seed, best seed first."""
    other = hops.select("anchor", "edge_id", F.when(F.col("anchor") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")).alias("end"))
    ends = facts.select("fact_id", F.explode(F.array("subject_id", "object_id")).alias("end")).join(fact_evidence, "fact_id").select("end", F.col("evidence_id").alias("reference")).distinct()
    out = seeds.withColumnRenamed("entity", "anchor").join(other, "anchor").join(ends, "end").filter("reference <> evidence_id")
    best = out.groupBy("query_id", F.col("reference").alias("evidence_id")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("evidence_id").alias("seed"), "anchor", "edge_id")).alias("via"))
    order = Window.partitionBy("query_id").orderBy("via", "evidence_id")
    return best.select("query_id", "evidence_id", F.row_number().over(order).alias("rank"))
