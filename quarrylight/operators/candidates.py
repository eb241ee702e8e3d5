"""What was retrieved, and the facts that lean on it, as candidates for a context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import canonical_uuid, content_id
from quarrylight.operators.retrieval import relevance
from quarrylight.runtime import durable


class Projection(NamedTuple):
    """``incomplete``: queries in which a fact or an input of one was left out."""

    candidates: DataFrame
    relations: DataFrame
    incomplete: DataFrame


def _best() -> Column:
    """An order in which the best comes first: score, then rank, then evidence."""
    return F.struct((-F.col("score")).alias("s"), F.col("rank").alias("r"), F.col("evidence_id").cast("string").alias("e"))


def retrieval_conflicts(retrieved: DataFrame) -> DataFrame:
    """query_id, id, reason: ids that can't be told apart, none if all are well.

    A unit with two external ids, an external id of two units, evidence of two units.
    """
    rules = (("unit_id", "external_id", "external_ids"), ("external_id", "unit_id", "units_of_external_id"), ("evidence_id", "unit_id", "units_of_evidence"))
    out = None
    for one, many, reason in rules:
        bad = retrieved.filter(F.col(one).isNotNull()).groupBy("query_id", F.col(one).cast("string").alias("id")).agg(F.min(many).alias("a"), F.max(many).alias("b")).filter("a <> b").select("query_id", "id", F.lit(reason).alias("reason"))
        out = bad if out is None else out.unionByName(bad)
    return out


def evidence_units(retrieved: DataFrame) -> DataFrame:
    """One row a query and unit: its best hit, its external id, whether a relation led to it."""
    return retrieved.filter("unit_id is not null").groupBy("query_id", "unit_id").agg(
        F.min(_best()).alias("best"), F.max("external_id").alias("external_id"), F.bool_or(F.coalesce("related", F.lit(False))).alias("related")
    )


def supported_facts(units: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that cite a unit of a query: query_id, fact_id, whole (all that they cite
    is there), evidence (unit ids in order), best, related.

    A reference is an external id before it is a unit's own id. A reference that a fact
    holds twice counts twice. Facts that cite nothing found aren't listed.
    """
    names = units.filter("external_id is not null").select("query_id", F.col("external_id").alias("ref"), F.lit(0).alias("way"), "unit_id", "best", "related")
    names = names.unionByName(units.select("query_id", F.col("unit_id").alias("ref"), F.lit(1).alias("way"), "unit_id", "best", "related"))
    names = names.groupBy("query_id", "ref").agg(F.min(F.struct("way", "unit_id", "best", "related")).alias("to")).select("query_id", "ref", "to.unit_id", "to.best", "to.related")
    cited = facts.select("fact_id", F.size("evidence").alias("n"), F.explode("evidence").alias("ref"))
    # a fact's references lie apart, so lists begun before the shuffle would hold one each
    return cited.join(names, "ref").drop("ref").repartition("query_id", "fact_id").groupBy("query_id", "fact_id").agg(
        (F.count("*") == F.first("n")).alias("whole"), F.array_sort(F.collect_list("unit_id")).alias("evidence"), F.min("best").alias("best"), F.bool_or("related").alias("related")
    )


def _aspects(first: Column, second: str, related: Column) -> Column:
    return F.array_compact(F.array(first, F.lit(second), F.when(related, "relation")))


def _scored(rows: DataFrame, kind: str, item: str, origin: Column, aspects: Column, evidence: Column) -> DataFrame:
    return rows.select("query_id", F.col(item).alias("item_id"), F.lit(kind).alias("kind"), origin.alias("origin"), relevance(-F.col("best.s")).alias("relevance"), F.col("best.r").alias("rank"), aspects.alias("aspects"), evidence.alias("evidence"))


def project(retrieved: DataFrame, facts: DataFrame) -> Projection:
    """Evidence, fact, entity and relation candidates of each query.

    ``retrieved``: query_id, evidence_id, unit_id, external_id (or null), score, rank,
    related; ``facts``: fact_id, statement (what it says, evidence apart), predicate,
    subject_id, subject_kind, object_id, object_kind (or null), evidence (array of
    ids), inputs (array of fact ids; null: observed, else derived).

    A fact is a candidate if all that it cites was retrieved; its id is told anew from
    its statement and the units it leans on, so facts that say the same of the same are one.
    Facts, their participants and relations take score and rank of the best evidence,
    a participant of the best fact (then the smallest fact id). Inputs are told in the new ids;
    one that is no candidate keeps its own. Candidates: query_id, item_id, kind, origin, relevance,
    rank, aspects, evidence, place (by rank, kind, id). Relations: query_id, relation_id, predicate,
    origin, from_id, to_id, path, supports, score, rank. Rows without a unit aren't candidates.
    """
    units, facts = durable(evidence_units(retrieved), "units"), durable(facts, "facts")
    found = durable(supported_facts(units, facts).withColumn("evidence", F.when(F.col("whole"), F.col("evidence"))), "supported")
    said = found.filter("whole").join(facts.select("fact_id", "statement", "predicate", "subject_id", "subject_kind", "object_id", "object_kind", "inputs"), "fact_id")
    said = durable(said.withColumn("item_id", content_id("fact", F.col("statement"), F.array_join("evidence", ","))), "projected")
    ids = said.select("query_id", F.col("fact_id").alias("input"), F.col("item_id").alias("told"))
    inputs = said.select("query_id", "fact_id", F.explode("inputs").alias("input")).join(ids, ["query_id", "input"], "left")
    lost = found.filter("not whole").select("query_id").unionByName(inputs.filter("told is null").select("query_id")).distinct()

    origin = F.when(F.col("inputs").isNotNull(), "derived").otherwise("observed")
    one = F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("best", "fact_id"))
    alone = said.withColumn("_n", one).filter("_n = 1").drop("_n")
    sides = F.filter(F.array(F.struct(F.col("subject_id").alias("id"), F.col("subject_kind").alias("kind")), F.struct(F.col("object_id").alias("id"), F.col("object_kind").alias("kind"))), lambda p: p["id"].isNotNull())
    takers = said.select("query_id", "best", "related", "evidence", "fact_id", origin.alias("origin"), F.explode(sides).alias("p"))
    first = F.struct("best", "fact_id", F.col("p.kind").alias("kind"), "origin")  # evidence apart, so that it moves only where it is wanted
    takers = takers.groupBy("query_id", F.col("p.id").alias("id")).agg(F.min(first).alias("top"), F.min_by("evidence", first).alias("evidence"), F.bool_or("related").alias("related")).select("query_id", "id", "top.*", "evidence", "related")
    part = F.when(F.col("kind").isin("artifact", "named_element"), F.col("kind")).otherwise("symbol")
    every = (
        _scored(units, "evidence", "unit_id", F.lit("observed"), _aspects(F.lit("evidence"), "source", F.col("related")), F.array("unit_id"))
        .unionByName(_scored(alone, "fact", "item_id", origin, _aspects(F.when(F.col("predicate") == "dependency", "dependency").otherwise("fact"), "evidence", F.col("related")), F.col("evidence")))
        .unionByName(_scored(takers, "entity", "id", F.col("origin"), _aspects(part, "locator", F.col("related")), F.col("evidence")))
    )
    every = every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "kind", "item_id")))
    links = alone.filter("subject_id <> object_id").select(
        "query_id", canonical_uuid("relation", F.col("item_id")).alias("relation_id"), "predicate", origin.alias("origin"), F.col("subject_id").alias("from_id"), F.col("object_id").alias("to_id"),
        F.array("subject_id", "object_id").alias("path"), F.concat(F.array("item_id"), F.col("evidence")).alias("supports"), relevance(-F.col("best.s")).alias("score"), F.col("best.r").alias("rank"),
    )
    return Projection(every, links, lost)
