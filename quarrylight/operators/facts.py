"""Canonical facts: identity, duplicates, conflicts, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import content_id

# The predicates, and those of which a subject has one assertion.
PREDICATES = ("artifact", "symbol", "named_element", "definition", "reference", "call", "dependency", "configuration", "endpoint", "message", "membership")
SINGULAR = ("artifact", "symbol", "named_element", "definition")


def fact_id(*parts: Column) -> Column:
    """Identity of scope, predicate, subject, object or value, qualifiers and
    producer; evidence and lineage are no part of it."""
    return content_id("fact", *parts)


def qualifier_key(qualifiers: Column) -> Column:
    """Qualifiers (array of name, value) as text in the order of their names."""
    return F.array_join(F.transform(F.array_sort(qualifiers), lambda q: F.concat_ws("=", q["name"], q["value"])), ";")


def typed_value(kind: str, column: Column) -> Column:
    """A tagged value: just the field of its kind is set."""
    types = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean"}
    if kind != "null" and kind not in types:
        raise ValueError(f"no such kind of value: {kind}")
    return F.struct(F.lit(kind).alias("kind"), *[(column if k == kind else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def invalid_values(facts: DataFrame) -> DataFrame:
    """Facts with both an object and a value, or a number that isn't finite."""
    number = F.col("value.number")
    return facts.filter((F.col("object_id").isNotNull() & F.col("value").isNotNull()) | F.isnan(number) | (F.abs(number) == float("inf")))


def first_of_each(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Duplicates of a key go; the first in ``order`` stays."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def conflicts(facts: DataFrame) -> DataFrame:
    """Slots (scope, predicate, subject) of singular predicates of which at least
    two producers say at least two different things, with their facts.

    A first pass keeps a least and a greatest assertion and producer for a slot, so
    facts move only where they differ. Facts of a slot in conflict are put in one row.
    """
    slot = ["scope", "predicate", "subject_id"]
    own = facts.filter(F.col("predicate").isin(*SINGULAR)).select(*slot, "assertion", "producer", "fact_id")
    ends = own.groupBy(*slot).agg(F.min("assertion").alias("a"), F.max("assertion").alias("b"), F.min("producer").alias("p"), F.max("producer").alias("q"))
    found = own.join(ends.filter("a <> b and p <> q").select(*slot), slot, "left_semi").groupBy(*slot).agg(
        F.size(F.collect_set("assertion")).cast("long").alias("assertions"), F.size(F.collect_set("producer")).cast("long").alias("producers"), F.array_sort(F.collect_set("fact_id")).alias("fact_ids")
    )
    return found.withColumn("conflict_id", content_id("conflict", *[F.col(c) for c in slot], F.array_join("fact_ids", ",")))


def unique_membership(definitions: DataFrame) -> DataFrame:
    """Symbols defined in exactly one artifact: membership and its least fact."""
    one = definitions.groupBy("scope", "symbol").agg(F.count_distinct("artifact").alias("n"), F.min("artifact").alias("artifact"), F.min("fact_id").alias("fact_id"))
    return one.filter("n = 1").drop("n")


def merged_evidence(facts: DataFrame) -> DataFrame:
    """Evidence references of all rows of a fact, each id with its least locator."""
    refs = facts.select("fact_id", F.explode("evidence").alias("e")).groupBy("fact_id", F.col("e.id").alias("id")).agg(F.min("e.locator").alias("locator"))
    return refs.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("id", "locator"))).alias("evidence"))


def missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not among the known keys; null refers to nothing."""
    return rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left_anti")


def ordered_digest(rows: DataFrame, by: list[str], key: Column, value: Column) -> DataFrame:
    """SHA-256 over the framed (key, value) pairs of each group in key order."""
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.octet_length(p["k"]).cast("string"), F.lit(":"), p["k"], F.octet_length(p["v"]).cast("string"), F.lit(":"), p["v"])), "")
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("n"))
