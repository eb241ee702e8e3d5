"""Differences of immutable snapshots and what they make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, same_configuration: bool = True) -> DataFrame:
    """(kind, key, status): reused, changed, added, removed.

    Both have kind, key, digest. A key that a side has more than once is never
    matched: its rows are removed on the one and added on the other side. Under
    another configuration every matched key is changed. One full outer join.
    """

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("kind", "key").agg(F.count("*").alias(f"n_{side}"), F.min("digest").alias(f"digest_{side}"))

    both = counted(before, "old").join(counted(after, "new"), ["kind", "key"], "full_outer")
    old, new = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    equal = F.lit(same_configuration) & F.col("digest_old").eqNullSafe(F.col("digest_new"))
    status = F.when((old == 1) & (new == 1), F.array(F.when(equal, "reused").otherwise("changed"))).otherwise(
        F.concat(F.array_repeat(F.lit("removed"), old.cast("int")), F.array_repeat(F.lit("added"), new.cast("int")))
    )
    return both.select("kind", "key", F.explode(status).alias("status"))


def projection_impact(diff: DataFrame, dependencies: DataFrame, profile_changed: bool = False) -> DataFrame:
    """(projection, key, status): affected, removed or reusable.

    ``dependencies``: projection, key, depends_on (a key of the diff). A new
    profile makes all rows of ``vector``, and only those, affected.
    """
    rank = F.when(F.col("status").isin("changed", "added"), 1).when(F.col("status") == "removed", 2).otherwise(0)
    touched = diff.groupBy(F.col("key").alias("depends_on")).agg(F.max(rank).alias("rank"))
    rows = dependencies.join(touched, "depends_on", "left").groupBy("projection", "key").agg(F.max(F.coalesce("rank", F.lit(0))).alias("rank"))
    affected = (F.col("rank") == 1) | (F.lit(profile_changed) & (F.col("projection") == "vector"))
    return rows.select("projection", "key", F.when(F.col("rank") == 2, "removed").when(affected, "affected").otherwise("reusable").alias("status"))


def update_plan(diff: DataFrame, invalid: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived facts of the former snapshot: reusable, or reevaluate with reasons."""
    out = derived.join(invalid, "fact_id", "left")
    return out.select("fact_id", F.when(F.col("reasons").isNull(), "reusable").otherwise("reevaluate").alias("action"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def embedding_rebuild(requested: DataFrame, cache: DataFrame, supplied: DataFrame, profile: str) -> DataFrame:
    """Where each requested content's vector comes from: cache, supplied, missing.

    ``cache``: profile_id, content_hash, item_id, state, vector; of several ready
    items the least id serves. ``supplied``: content_hash, vector.
    """
    ready = cache.filter((F.col("profile_id") == profile) & (F.col("state") == "ready")).groupBy("content_hash").agg(F.min_by("vector", "item_id").alias("cached"), F.min("item_id").alias("item_id"))
    given = supplied.groupBy("content_hash").agg(F.first("vector").alias("given"))
    out = requested.join(ready, "content_hash", "left").join(given, "content_hash", "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("given").isNotNull(), "supplied").otherwise("missing")
    return out.select(*requested.columns, origin.alias("origin"), "item_id", F.coalesce("cached", "given").alias("vector"))


def text_rebuild(entries: DataFrame, former: DataFrame, columns: list[str]) -> DataFrame:
    """New projection rows: carried forward if all of ``columns`` match, else inserted."""
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns]
    hit = former.alias("f").select(*[F.col(f"f.{c}") for c in ["evidence_id", *columns]]).distinct().alias("f")
    cond = F.col("e.evidence_id") == F.col("f.evidence_id")
    for s in same:
        cond = cond & s
    out = entries.alias("e").join(hit, cond, "left")
    return out.select("e.*", F.when(F.col("f.evidence_id").isNull(), "inserted").otherwise("carried").alias("action"))


def memo(artifacts: DataFrame, cache: DataFrame, invalid_paths: DataFrame, key: list[str]) -> DataFrame:
    """Artifacts to analyse or to take from the cache of earlier results."""
    known = cache.select(*key, F.lit(True).alias("_hit")).distinct()
    out = artifacts.join(known, key, "left").join(invalid_paths.select("path", F.lit(True).alias("_bad")).distinct(), "path", "left")
    return out.withColumn("action", F.when(F.col("_hit").isNotNull() & F.col("_bad").isNull(), "reuse").otherwise("analyze")).drop("_hit", "_bad")


def claim_order(jobs: DataFrame, now) -> DataFrame:
    """Jobs in the order in which they are claimed: pending ones and running ones
    whose lease has ended, or ends now, or that have none, oldest first; never one
    that is asked to be cancelled (``cancel_requested``, if there is such a column).
    Ties: the smaller job_id. No jobs: no rows."""
    ended = F.coalesce(F.col("lease_until") <= F.lit(now), F.lit(True))
    free = jobs.filter((F.col("state") == "pending") | ((F.col("state") == "running") & ended))
    if "cancel_requested" in jobs.columns:
        free = free.filter(~F.coalesce("cancel_requested", F.lit(False)))
    return free.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("created_at", "job_id"))).withColumn("attempt", F.col("attempt") + 1)


def append_new(rows: DataFrame, stored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows that contradict what is stored under their key)."""
    others = [c for c in rows.columns if c not in key]
    fresh = rows.join(stored.select(*key), key, "left_anti").dropDuplicates(key)
    old = stored.select(*key, F.struct(*others).alias("_old"))
    clash = rows.join(old, key).filter(~F.struct(*others).eqNullSafe(F.col("_old"))).drop("_old")
    return fresh, clash


def work_saved(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("reused", "changed", "added", "removed")])


def limited_walk(files: DataFrame, max_files: int, max_file_bytes: int, max_bytes: int) -> DataFrame:
    """Files in walk order up to the first that breaks a limit (it and all after
    it are out). ``files``: root, path, size. Per root."""
    order = Window.partitionBy("root").orderBy("path")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = files.withColumns({"place": F.row_number().over(order), "total": F.sum("size").over(upto)})
    broken = (F.col("place") > max_files) | (F.col("size") > max_file_bytes) | (F.col("total") > max_bytes)
    rows = rows.withColumn("broken", F.max(broken.cast("int")).over(upto))
    return rows.filter("broken = 0").drop("broken")
