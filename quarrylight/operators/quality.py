"""How good each run of a variant was, and all metrics of all variants as one report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.evaluation import ratio
from quarrylight.runtime import durable

#: What a run costs and how good it was; a report leaves out what a table doesn't have.
METRICS = (
    "actual_cost", "estimated_cost", "measured_input_tokens", "measured_output_tokens", "estimated_input_tokens", "estimated_output_tokens", "model_calls", "tool_calls", "files_read", "bytes_read", "duration",
    "correct", "completed", "criteria_passed", "evidence_recall", "evidence_precision", "citation_rate", "gap_recall", "abstention_appropriate",
)


def _ids(name: str) -> Column:
    """An array's ids, each once; null: none."""
    return F.array_distinct(F.filter(F.coalesce(F.col(name), F.array()), lambda x: x.isNotNull()))


def derive_quality(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` with what each says of its case, by ids alone.

    ``cases``: case_id, reference_claims, expected_evidence, expected_gaps (arrays of
    ids), acceptable (array of claim_id, evidence_ids), abstention_expected; ``results``:
    case_id, claims, evidence, gaps (arrays of ids), citations (array of claim_id,
    evidence_id), status, conclusion. A result without a case is left out.

    Adds correct (the same claims as the reference), expected, retrieved, relevant,
    evidence_recall, evidence_precision, citations_total, citations_valid, citation_rate,
    gaps_expected, gaps_recognized, gap_recall, abstention_actual, abstention_appropriate, completed.
    A citation is valid if the run makes its claim, has its evidence, and the case accepts
    the two together. Expected evidence without an id counts as expected, and is never found.
    Rates are null where there is nothing to count. Repeated ids count once, repeated citations each time.
    """
    case = cases.select(
        "case_id", _ids("reference_claims").alias("_claims"), _ids("expected_evidence").alias("_evidence"), F.coalesce(F.size("expected_evidence"), F.lit(0)).alias("expected"), _ids("expected_gaps").alias("_gaps"),
        F.coalesce(F.col("acceptable"), F.array()).alias("_acceptable"), F.coalesce("abstention_expected", F.lit(False)).alias("_abstain"),
    )
    rows = results.join(case, "case_id").withColumns({"_c": _ids("claims"), "_e": _ids("evidence"), "_g": _ids("gaps")})

    def valid(c: Column) -> Column:
        accepted = F.exists("_acceptable", lambda a: (a["claim_id"] == c["claim_id"]) & F.array_contains(a["evidence_ids"], c["evidence_id"]))
        return F.coalesce(F.array_contains("_c", c["claim_id"]) & F.array_contains("_e", c["evidence_id"]) & accepted, F.lit(False))

    abstained, done = F.coalesce(F.col("conclusion") == "abstained", F.lit(False)), F.coalesce(F.col("status") == "completed", F.lit(False))
    passed = F.coalesce(F.col("conclusion") == "passed", F.lit(False))
    n = F.size
    rows = rows.withColumns({
        "correct": (n("_c") == n("_claims")) & (n(F.array_except("_c", "_claims")) == 0), "retrieved": n("_e"), "relevant": n(F.array_intersect("_e", "_evidence")),
        "citations_total": F.coalesce(n("citations"), F.lit(0)), "citations_valid": F.coalesce(n(F.filter("citations", valid)), F.lit(0)), "gaps_expected": n("_gaps"), "gaps_recognized": n(F.array_intersect("_g", "_gaps")),
        "abstention_actual": abstained, "abstention_appropriate": done & (passed | abstained) & (F.col("_abstain") == abstained), "completed": done & (passed | (abstained & F.col("_abstain"))),
    })
    rates = {"evidence_recall": ("relevant", "expected"), "evidence_precision": ("relevant", "retrieved"), "citation_rate": ("citations_valid", "citations_total"), "gap_recall": ("gaps_recognized", "gaps_expected")}
    return rows.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()}).drop("_claims", "_evidence", "_gaps", "_acceptable", "_abstain", "_c", "_e", "_g")


def metric_rows(runs: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``by``, metric, value: one row for each finite value of a metric that ``runs`` has.
    True is 1, false 0; nulls, NaN and infinities are no values."""
    known = [m for m in metrics if m in runs.columns]
    if not known:
        raise ValueError("the runs have none of the metrics")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in known])
    rows = runs.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def metric_report(runs: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS, accuracy: int = 1000) -> DataFrame:
    """count, min, mean, exact median, max, population deviation of every metric and group.

    The runs are read once: their groups and metrics are written as a narrow table. All
    metrics go through one shuffle of partial sums, which also brings two bounds
    around the median (approximate quantiles whose rank is off by at most one in
    ``accuracy``). Then only values between the bounds, counted each, are put in order;
    so a group of any size needs no more memory. Null groups are groups.
    """
    known = [m for m in metrics if m in runs.columns]
    if not known:
        raise ValueError("the runs have none of the metrics")
    runs = durable(runs.select(*by, *[F.col(m).cast("double").alias(m) for m in known if m not in by]), "metrics")
    rows, key = metric_rows(runs, by, metrics), [*by, "metric"]
    off = 2.0 / accuracy
    v = F.col("value")
    told = rows.groupBy(*key).agg(
        F.count("*").alias("count"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev"), F.percentile_approx(v, [max(0.0, 0.5 - off), min(1.0, 0.5 + off)], accuracy).alias("bounds")
    )
    told = durable(told, "told")
    # groups are few as a rule, and their files tell so: then values aren't shuffled to meet them
    names = [f"_k{i}" for i in range(len(key))]
    groups = told.select(*[F.col(c).alias(k) for c, k in zip(key, names, strict=True)], F.col("count").alias("_count"), F.get("bounds", F.lit(0)).alias("_from"), F.get("bounds", F.lit(1)).alias("_to"))
    same = F.lit(True)
    for c, k in zip(key, names, strict=True):
        same = same & rows[c].eqNullSafe(groups[k])
    near = rows.join(groups, same & (rows["value"] <= groups["_to"]))
    near = near.groupBy(*names, "_count", F.when(v >= F.col("_from"), v).alias("value")).agg(F.count("*").alias("n"))  # null: all below the bounds
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low, high = F.floor((F.col("_count") - 1) / 2), F.floor(F.col("_count") / 2)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    middle = near.withColumn("upto", upto).filter(holds(low) | holds(high)).groupBy(*names).agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    same = F.lit(True)
    for c, k in zip(key, names, strict=True):
        same = same & told[c].eqNullSafe(middle[k])
    return told.join(middle, same).select(*[told[c] for c in key], "count", "min", "mean", "median", "max", "stddev")
