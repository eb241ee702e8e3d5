"""Observations to canonical facts: one select per rule, united by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.facts import fact_id

FACTS = ["fact_id", "scope", "predicate", "subject_kind", "subject_id", "object_kind", "object_id", "value", "producer", "path", "line"]

#: (observation type, predicate, subject kind, subject, object kind, object, value)
#: where n is the name, d the detail and p the path of the observation.
RULES = {
    "java": (
        ("package", "named_element", "named_element", "n", None, None, "n"), ("package", "membership", "artifact", "p", "named_element", "n", None),
        ("type", "symbol", "symbol", "n", None, None, "d"), ("type", "definition", "artifact", "p", "symbol", "n", None),
        ("method", "symbol", "symbol", "n", None, None, None), ("method", "definition", "artifact", "p", "symbol", "n", None),
        ("import", "reference", "artifact", "p", "named_element", "n", None), ("import", "dependency", "artifact", "p", "named_element", "n", None),
        ("extends", "dependency", "symbol", "d", "symbol", "n", None), ("implements", "dependency", "symbol", "d", "symbol", "n", None),
        ("call", "call", "artifact", "p", "symbol", "n", None), ("construct", "dependency", "artifact", "p", "symbol", "n", None),
        ("config_property", "configuration", "artifact", "p", "named_element", "n", None), ("config_access", "configuration", "artifact", "p", "named_element", "n", None),
        ("endpoint", "endpoint", "artifact", "p", "named_element", "n", None),
    ),
    "python": (
        ("symbol", "symbol", "symbol", "n", None, None, "d"), ("symbol", "definition", "artifact", "p", "symbol", "n", None),
        ("import", "reference", "artifact", "p", "named_element", "n", None), ("import", "dependency", "artifact", "p", "named_element", "n", None),
        ("framework_call", "reference", "artifact", "p", "named_element", "n", None),
        ("config_access", "configuration", "artifact", "p", "named_element", "n", None), ("assignment", "configuration", "artifact", "p", "named_element", "n", None),
    ),
    "xml": (
        ("type", "named_element", "named_element", "n", None, None, "d"), ("type", "membership", "artifact", "p", "named_element", "n", None),
        ("include", "dependency", "artifact", "p", "named_element", "n", None), ("reference", "reference", "artifact", "p", "named_element", "n", None),
        ("endpoint", "endpoint", "artifact", "p", "named_element", "n", None), ("message", "message", "artifact", "p", "named_element", "n", None),
        ("config", "configuration", "artifact", "p", "named_element", "n", None),
    ),
}


def normalize(observations: DataFrame, frontend: str, scope: str, version: str = "1") -> DataFrame:
    """Facts of all rules of a frontend, and one artifact fact for each file.

    Equal facts are one, seen at their first line. A detail that a rule needs and
    that is null gives no fact.
    """
    at = {"n": F.col("name"), "d": F.col("detail"), "p": F.col("path"), None: F.lit(None).cast("string")}
    parts = [observations.select(F.lit("artifact").alias("predicate"), F.lit("artifact").alias("subject_kind"), F.col("path").alias("subject_id"), F.lit(None).cast("string").alias("object_kind"), F.lit(None).cast("string").alias("object_id"), F.lit(frontend).alias("value"), "path", F.lit(0).alias("line"))]
    for kind, predicate, sk, s, ok, o, v in RULES[frontend]:
        rows = observations.filter(F.col("type") == kind)
        parts.append(rows.select(F.lit(predicate).alias("predicate"), F.lit(sk).alias("subject_kind"), at[s].alias("subject_id"), F.lit(ok).cast("string").alias("object_kind"), at[o].alias("object_id"), at[v].alias("value"), "path", "line").filter(F.col("subject_id").isNotNull() & (F.lit(ok is None) | F.col("object_id").isNotNull())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumns({"scope": F.lit(scope), "producer": F.lit(f"{frontend}/{version}")})
    key = [F.col(c) for c in ("scope", "predicate", "subject_kind", "subject_id", "object_kind", "object_id", "value", "producer")]
    out = out.withColumn("fact_id", fact_id(*key))
    first = out.groupBy("fact_id", *[c for c in FACTS if c not in ("fact_id", "path", "line")]).agg(F.min(F.struct("path", "line")).alias("at"))
    return first.select(*[c for c in FACTS if c not in ("path", "line")], "at.path", "at.line")


def dispatch(contributions: DataFrame, mapping: DataFrame) -> DataFrame:
    """contributions with their normalizer by (analyzer, version, method, type);
    none: coverage is incomplete. The mapping has a row per normalizer."""
    key = ["analyzer_id", "analyzer_version", "method", "type"]
    out = contributions.join(F.broadcast(mapping), key, "left")
    return out.withColumn("coverage", F.when(F.col("normalizer").isNull(), "incomplete").otherwise("produced"))


def select_frontend(manifests: DataFrame, version: str) -> DataFrame:
    """Per frontend: the one exact version, else the one fallback, else unsupported;
    more than one of a kind is ambiguous."""
    counted = manifests.groupBy("frontend").agg(
        F.count_if(F.col("version") == version).alias("exact"), F.count_if("fallback").alias("fallbacks"), F.min(F.when(F.col("version") == version, F.col("manifest_id"))).alias("e"), F.min(F.when(F.col("fallback"), F.col("manifest_id"))).alias("f")
    )
    state = F.when(F.col("exact") > 1, "ambiguous").when(F.col("exact") == 1, "exact").when(F.col("fallbacks") > 1, "ambiguous").when(F.col("fallbacks") == 1, "fallback").otherwise("unsupported")
    return counted.select("frontend", state.alias("state"), F.when(state == "exact", F.col("e")).when(state == "fallback", F.col("f")).alias("manifest_id"))
