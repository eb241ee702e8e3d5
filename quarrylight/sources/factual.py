"""The factual store: canonical facts and their supports in tables that one marker
publishes together.

A write stages a batch of every table and then its marker, a single row in a table
of its own; readers see the batches that have one, so all tables of a batch appear
at once and an interrupted write isn't seen. Facts that the store holds already
aren't written again; a fact that differs from the one of its id refuses the whole
write. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.runtime import brief_shuffles, discard, durable

#: The supports of a fact: each an array, whose order is kept as ordinals.
SUPPORTS = ("qualifiers", "evidence", "inputs")
MARKERS = "batch string, facts long, at timestamp"
#: Digests in hexadecimal and ids that are alike take half the room.
SMALL = "zstd"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def batches(spark: SparkSession, store: str) -> list[str]:
    """The published batches, in order of their markers; a few per write."""
    if not _exists(spark, f"{store}/markers"):
        return []
    return [r["batch"] for r in spark.read.schema(MARKERS).parquet(f"{store}/markers").orderBy("at", "batch").collect()]


def _table(spark: SparkSession, store: str, name: str, published: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{store}/{name}/{b}" for b in published])


def fact_digest(facts: DataFrame) -> DataFrame:
    """``facts`` and digest, a SHA-256 of everything but scope and id, nulls included."""
    own = [c for c in sorted(facts.columns) if c not in ("scope", "fact_id")]
    return facts.withColumn("digest", F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256))


def _told(rows: DataFrame, store: str) -> DataFrame:
    """scope, fact_id, given (how often in ``rows``), stored, differs: of the facts with
    a digest in ``rows`` and of the store. A digest goes as four numbers, of which
    the least and the greatest are kept: nothing is sorted, and stored texts stay."""
    spark = rows.sparkSession
    every = rows.select("scope", "fact_id", "digest", F.lit(1).alias("given"))
    if published := batches(spark, store):
        every = every.unionByName(_table(spark, store, "facts", published).select("scope", "fact_id", "digest", F.lit(0).alias("given")))
    parts = [F.conv(F.substr("digest", F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long") for i in range(4)]
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("a", F.min), ("b", F.max))]
    found = every.select("scope", "fact_id", "given", *[p.alias(f"d{i}") for i, p in enumerate(parts)]).groupBy("scope", "fact_id").agg(F.sum("given").alias("given"), (F.min("given") == 0).alias("stored"), *ends)
    return found.filter("given > 0").select("scope", "fact_id", "given", "stored", F.expr(" OR ".join(f"a{i} <> b{i}" for i in range(4))).alias("differs"))


def conflicts(facts: DataFrame, store: str) -> DataFrame:
    """(scope, fact_id) of facts that differ from another of the same id, among
    themselves or in the store."""
    return _told(fact_digest(facts), store).filter("differs").select("scope", "fact_id")


def persist_facts(facts: DataFrame, store: str, fixed: bool = False) -> int:
    """Add the facts that the store doesn't hold; how many those are.

    Needs scope, fact_id and the arrays of SUPPORTS; all other columns are kept.
    ValueError, and nothing written, if a fact is without an id or a scope, or
    differs from one of the same id. Repeated equal facts are one. A write of what
    is there already changes nothing. Its own copies are gone when it ends, and so
    are its shuffles. ``fixed``: the facts come from files, are the same and cheap
    each time they are read, and need no copy.
    """
    with brief_shuffles(facts.sparkSession):
        return _persist(facts, store, fixed)


def _persist(facts: DataFrame, store: str, fixed: bool) -> int:
    spark = facts.sparkSession
    rows, copies = fact_digest(facts), []
    try:
        if not fixed:
            rows = durable(rows, "facts", SMALL)
            copies.append(rows)
        is_new = F.when(~F.col("stored"), 1)
        told = _told(rows, store).agg(
            F.count_if(F.col("scope").isNull() | F.col("fact_id").isNull()).alias("nameless"), F.count_if("differs").alias("differ"), F.min(F.when(F.col("differs"), F.col("fact_id"))).alias("bad"),
            F.count(is_new).alias("new"), F.count_if("stored").alias("stored"), F.coalesce(F.max("given"), F.lit(0)).alias("most"),
        ).first()
        if told["nameless"]:
            raise ValueError("a fact has no id or no scope")
        if told["differ"]:
            raise ValueError(f"{told['differ']} facts differ from those of the same id: {told['bad']} and others")
        if not told["new"]:
            return 0
        if told["stored"]:
            rows = rows.join(_table(spark, store, "facts", batches(spark, store)).select("scope", "fact_id"), ["scope", "fact_id"], "left_anti")
        if told["most"] > 1:
            rows = rows.dropDuplicates(["scope", "fact_id"])
        if told["stored"] or told["most"] > 1:
            rows = durable(rows if "digest" in facts.columns else rows.drop("digest"), "new-facts", SMALL)
            copies.append(rows)
        batch = uuid.uuid4().hex
        for name in SUPPORTS:
            rows.select("scope", "fact_id", F.posexplode(name).alias("ordinal", "support")).write.parquet(f"{store}/{name}/{batch}", compression=SMALL)
        (rows if "digest" in rows.columns else fact_digest(rows)).drop(*SUPPORTS).write.parquet(f"{store}/facts/{batch}", compression=SMALL)
        spark.createDataFrame([(batch, told["new"])], "batch string, facts long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{store}/markers")
        return told["new"]
    finally:
        for copy in copies:
            discard(copy)


def read_facts(spark: SparkSession, store: str, scope: str | None = None) -> DataFrame | None:
    """All published facts, or a scope's, with their supports in the order in which
    they were written; None for a store without any. A fact without supports has
    empty arrays (a null array comes back empty)."""
    published = batches(spark, store)
    if not published:
        return None
    wanted = F.lit(True) if scope is None else F.col("scope") == scope
    out = _table(spark, store, "facts", published).filter(wanted)
    for name in SUPPORTS:
        rows = _table(spark, store, name, published).filter(wanted)
        kind = rows.schema["support"].dataType.simpleString()
        lists = rows.groupBy("scope", "fact_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "support"))).alias("s"))
        lists = lists.select("scope", "fact_id", F.transform("s", lambda x: x["support"]).alias(name))
        out = out.join(lists, ["scope", "fact_id"], "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return out
