"""Quality and efficiency of retrieval runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null if there is nothing to be part of."""
    return F.when(whole > 0, part / whole)


def retrieval_metrics(expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """case_id, recall, precision, first_hit (-1: none) over the first k ranks."""
    first = retrieved.filter(F.col("rank") <= k).groupBy("case_id", "evidence_id").agg(F.min("rank").alias("rank"))
    hits = first.join(expected.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_semi")
    per_hits = hits.groupBy("case_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first_hit"))
    wanted = expected.groupBy("case_id").agg(F.count_distinct("evidence_id").alias("expected"))
    got = first.groupBy("case_id").agg(F.count("*").alias("retrieved"))
    out = wanted.join(got, "case_id", "left").join(per_hits, "case_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return out.select("case_id", ratio(n, F.col("expected")).alias("recall"), ratio(n, F.coalesce("retrieved", F.lit(0))).alias("precision"), F.coalesce("first_hit", F.lit(-1)).alias("first_hit"))


def distribution(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """count, min, mean, exact median, max, population deviation; nulls don't count."""
    m = F.col(metric)
    return runs.groupBy(*by).agg(
        F.count(m).alias("count"), F.min(m).alias("min"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.max(m).alias("max"), F.stddev_pop(m).alias("stddev")
    )


def success() -> Column:
    """Completed, correct, required criteria passed, abstained rightly, and all
    of recall, gap recall and citation rate are 1."""
    rates = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("recall", "gap_recall", "citation_rate")]
    out = F.col("completed") & F.col("correct") & F.col("required_passed") & F.col("abstention_appropriate")
    for r in rates:
        out = out & r
    return F.coalesce(out, F.lit(False))


def per_success(runs: DataFrame, by: list[str], resource: str) -> DataFrame:
    """A resource over all runs by the number of successful ones; null without a
    success, with a missing value, or if observers differ."""
    x = F.col(resource)
    ok = (F.count(x) == F.count("*")) & (F.count_distinct("observer") == 1) & (F.sum(F.col("success").cast("int")) > 0)
    return runs.groupBy(*by).agg(F.count("*").alias("attempted"), F.sum(F.col("success").cast("int")).alias("successful"), F.when(ok, F.sum(x) / F.sum(F.col("success").cast("int"))).alias("per_success"))


def savings(runs: DataFrame, baseline: str, metric: str) -> DataFrame:
    """case_id, variant, comparable, reason, saving = 1 - candidate / baseline."""
    base = runs.filter(F.col("variant") == baseline).select("case_id", F.col("success").alias("_s"), F.col(metric).alias("_m"))
    out = runs.filter(F.col("variant") != baseline).join(base, "case_id", "left")
    reason = F.when(F.col("_s").isNull(), "baseline_missing").when(~F.col("_s"), "baseline_unsuccessful").when(~F.col("success"), "candidate_unsuccessful")
    saving = F.when(reason.isNull() & (F.col("_m") > 0), 1 - F.col(metric) / F.col("_m"))
    return out.select("case_id", "variant", reason.isNull().alias("comparable"), reason.alias("reason"), saving.alias("saving"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts by outcome and means over all cases."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("cases"), F.count_if(o == "completed").alias("completed"), F.count_if(o == "failed").alias("failed"), F.count_if(o == "abstained").alias("abstained"),
        F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
    )


def coverage_status(coverage: DataFrame, gaps: DataFrame, failures: DataFrame) -> DataFrame:
    """scope, partial: any gap or failure, or coverage that isn't produced or
    not applicable."""
    bad = coverage.groupBy("scope").agg(F.bool_or(~F.col("state").isin("produced", "not_applicable")).alias("bad"))
    g = gaps.groupBy("scope").agg(F.count("*").alias("gaps"))
    f = failures.groupBy("scope").agg(F.count("*").alias("failures"))
    out = bad.join(g, "scope", "full_outer").join(f, "scope", "full_outer")
    return out.select("scope", (F.coalesce("bad", F.lit(False)) | (F.coalesce("gaps", F.lit(0)) > 0) | (F.coalesce("failures", F.lit(0)) > 0)).alias("partial"))


def run_variants(cases: DataFrame, executions: DataFrame) -> DataFrame:
    """case x variant: the outcome of its execution, or why there is none."""
    plan = cases.select("case_id", F.explode("variants").alias("variant"))
    out = plan.join(executions, ["case_id", "variant"], "left")
    return out.withColumn("outcome", F.when(F.col("status").isNull(), "executor_missing").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))


def overlapping(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Candidate matches of locators on one path whose line ranges overlap.

    A missing actual start matches all lines; a start of 0 is 1, an end before
    the start is the start. An equi-join on the path with a range residual.
    """

    def lines(df: DataFrame, p: str, id_: str) -> DataFrame:
        start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
        return df.select("case_id", F.col(id_).alias(f"{p}_id"), "path", start.alias(f"{p}_start"), F.greatest(F.coalesce("end_line", start), start).alias(f"{p}_end"), F.col("start_line").isNull().alias(f"{p}_open"))

    x, a = lines(expected, "expected", "expected_id"), lines(actual, "actual", "evidence_id")
    hit = F.col("actual_open") | ((F.col("expected_start") <= F.col("actual_end")) & (F.col("actual_start") <= F.col("expected_end")))
    return x.join(a, ["case_id", "path"]).filter(hit)


def greedy_match(candidates: DataFrame) -> DataFrame:
    """In expected order the best unused unit, else the best one again.

    ``candidates``: case_id, expected_id, evidence_id, score.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for expected, part in pdf.sort_values(["expected_id", "score", "evidence_id"], ascending=[True, False, True]).groupby("expected_id", sort=True):
            free = part[~part["evidence_id"].isin(used)]
            best = (free if len(free) else part).iloc[0]
            used.add(best["evidence_id"])
            out.append((best["case_id"], expected, best["evidence_id"], len(free) == 0))
        return pd.DataFrame(out, columns=["case_id", "expected_id", "evidence_id", "reused"])

    t = dict(candidates.dtypes)
    return candidates.groupBy("case_id").applyInPandas(one, f"case_id {t['case_id']}, expected_id {t['expected_id']}, evidence_id {t['evidence_id']}, reused boolean")


def bipartite_match(candidates: DataFrame) -> DataFrame:
    """A maximum matching of each case by augmenting paths, best scores first."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        options = {e: p.sort_values(["score", "evidence_id"], ascending=[False, True])["evidence_id"].tolist() for e, p in pdf.groupby("expected_id")}
        owner: dict = {}
        for first in sorted(options):
            # breadth-first search for a free unit, then the path is flipped
            queue, came, free = [first], {}, None
            while queue and free is None:
                e = queue.pop(0)
                for u in options[e]:
                    if u in came:
                        continue
                    came[u] = e
                    if u not in owner:
                        free = u
                        break
                    queue.append(owner[u])
            while free is not None:
                e = came[free]
                before = next((u for u, o in owner.items() if o == e), None)
                if before is not None:
                    del owner[before]
                owner[free] = e
                free = before
        case = pdf["case_id"].iloc[0]
        return pd.DataFrame([(case, e, u) for u, e in sorted(owner.items(), key=lambda x: x[1])], columns=["case_id", "expected_id", "evidence_id"])

    t = dict(candidates.dtypes)
    return candidates.groupBy("case_id").applyInPandas(one, f"case_id {t['case_id']}, expected_id {t['expected_id']}, evidence_id {t['evidence_id']}")


def unique_by_name(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """dependency -> path: by full path, else by a base name that is one file's."""
    base = F.element_at(F.split("path", "/"), -1)
    by_base = files.withColumn("base", base).withColumn("n", F.count("*").over(Window.partitionBy("base"))).filter("n = 1").select("base", F.col("path").alias("by_base"))
    full = files.select(F.col("path").alias("target"), F.col("path").alias("by_path"))
    out = dependencies.join(full, "target", "left").withColumn("base", F.element_at(F.split("target", "/"), -1)).join(by_base, "base", "left")
    return out.select(*dependencies.columns, F.coalesce("by_path", "by_base").alias("resolved"))
