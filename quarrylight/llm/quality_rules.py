"""Quality rules whose cutoffs carry a guarantee. Built-in functions only.

A cutoff of a measure may be used in a stratum if it provably rejects few good
documents: on a labelled holdout of n good documents of which the cutoff rejects
k, the exact binomial test of "it rejects more than ``alpha`` of them" must give
P(Binomial(n, alpha) <= k) <= delta / chains. The cutoffs of a stratum and measure
are one chain, tested in a fixed order from lax to strict until the first that
fails, which needs no correction inside the chain (k, and with it the tail, only
grows); the correction is for the chains, all strata times all measures. So with
probability 1 - delta every cutoff that passes, of every chain, keeps its promise,
and whichever of them may be chosen: that which rejects most of the bad holdout
documents beyond its share of good ones. A measure that tells bad from good no
better than chance gets no cutoff, nor does a stratum with too few labels to
prove anything (under about 180 good ones with four strata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACES, materialize

SYMBOLS = "#*$%&|<>"
#: Measures in thousandths, and the cutoffs tried: reject if the measure is above.
GRID = tuple(range(0, 1000, 25))
MEASURES = ("symbols", "dup_lines", "repeats")
ALPHA, DELTA = 0.03, 0.05


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the contract's counts of every whole text.

    A null text has no words. The repeated three-word windows of a text are
    found by sorting the hashes of its windows: equal neighbours repeat.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], docs["lang"], text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("w"),
    )
    n = F.size("w")
    window = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
    )
    rows = rows.withColumn("s", F.when(n >= 3, F.array_sort(window)))
    # one element at a time: a field of the whole array would copy it each time
    h = lambda i: F.get("s", i)["h"]
    at = F.sequence(F.lit(0), F.size("s") - 1)
    rows = rows.withColumn("again", F.filter(at, lambda i: (h(i) == h(i - 1)) | (h(i) == h(i + 1))))
    rows = rows.withColumn("at", F.array_sort(F.transform("again", lambda i: F.get("s", i)["i"])))
    # each window in order covers three words less those of the window before it
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def with_rates(rows: DataFrame) -> DataFrame:
    """Adds base_failed and the measures, whole thousandths rounded down."""

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"(1000 * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")

    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols": rate("n_symbols", "word_chars"),
            "dup_lines": rate("n_dup_lines", "n_lines"),
            "repeats": rate("n_repeat_words", "n_words"),
            "stratum": F.coalesce("lang", F.lit("")),
        }
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms."""
    log_odds = F.lit(p / (1 - p))
    start = n * F.log1p(F.lit(-p))
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(start.cast("double").alias("term"), F.exp(start).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log((n - i + 1) / i * log_odds)).alias("term"),
            (acc["sum"] + F.when(i <= k, F.exp(acc["term"] + F.log((n - i + 1) / i * log_odds))).otherwise(F.lit(0.0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )


def cutoffs(rated: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid=GRID, measures=MEASURES) -> DataFrame:
    """stratum and, for each measure, the cutoff chosen (null: none).

    The holdout is every row of ``rated`` that passes the base rules and has a
    label; labels that repeat a doc_id count once, as good (quality = 1) only if
    none of them says otherwise; null labels and null ids tell nothing. First a
    histogram of the measures is made, so only strata x measures x cutoffs rows go
    on, whatever the input's size. Ties: the laxest cutoff.
    """
    told = labels.groupBy(labels["doc_id"].alias("id")).agg(F.min("quality").alias("quality")).filter("quality in (0, 1) and id is not null")
    held = rated.filter("not base_failed").join(told, F.col("doc_id") == F.col("id"))
    sides = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    counts = held.select("stratum", "quality", F.explode(sides).alias("m")).groupBy("stratum", "quality", "m.measure", "m.value").agg(F.count("*").alias("n"))
    steps = counts.select("stratum", "quality", "measure", "value", "n", F.explode(F.array(*[F.lit(g).cast("long") for g in grid])).alias("cutoff"))

    def total(quality: int, over: bool) -> Column:
        counted = (F.col("quality") == quality) & ((F.col("value") > F.col("cutoff")) if over else F.lit(True))
        return F.sum(F.when(counted, F.col("n")).otherwise(0))

    tried = steps.groupBy("stratum", "measure", "cutoff").agg(total(1, False).alias("n"), total(1, True).alias("k"), total(0, False).alias("bad"), total(0, True).alias("caught"))
    # a stratum without a good document proves nothing, so it isn't tested
    tried = tried.filter("n > 0")
    strata = tried.select(F.count_distinct("stratum").alias("strata"))
    bound = F.lit(delta) / (F.col("strata") * len(measures))
    # beyond the mean the tail is never below a bound under one half, so long sums are spared
    hopeful = F.col("k") <= F.floor(F.col("n") * alpha)
    # one row: the number of strata
    proven = tried.join(F.broadcast(strata)).filter(hopeful).filter(binomial_tail(F.col("n"), F.col("k"), alpha) <= bound)
    # caught / bad - k / n, in whole numbers over the same whole
    gain = F.col("caught") * F.col("n") - F.col("k") * F.col("bad")
    best = F.max(F.when(gain > 0, F.struct(gain.alias("gain"), "cutoff")))
    chosen = proven.groupBy("stratum", "measure").agg(best.alias("best"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("measure") == m, F.col("best.cutoff"))).alias(f"cut_{m}") for m in measures])


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs``.

    The strata are the languages; a null lang is one more. Null or missing
    labels prove nothing. Repeated rows are each judged. An empty ``labels``
    leaves only the base rules.
    """
    # written once: the counts are used twice, and a filter must not be pushed into them;
    # a row a stratum is broadcast, and strata are languages
    rated = with_rates(materialize(base_measures(docs), "measures"))
    chosen = cutoffs(rated, labels, **options).withColumnRenamed("stratum", "_stratum")
    judged = rated.join(F.broadcast(chosen), F.col("stratum") == F.col("_stratum"), "left")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"),
        "stratum", *MEASURES, *[f"cut_{m}" for m in MEASURES],
    )


#: The contract's rows in DuckDB; the exact tail by log-gamma.
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
numbered AS (SELECT row_number() OVER () AS rid, * FROM w),
tri AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM numbered WHERE len(words) >= 3),
tri2 AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM tri),
covered AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM tri2, (VALUES (0), (1), (2)) AS v(o) WHERE c >= 2 GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM numbered),
base AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered n JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats
  FROM base),
told AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) IN (0, 1)),
held AS (SELECT * FROM rated JOIN told USING (doc_id) WHERE NOT base_failed),
long AS (
  SELECT stratum, quality, 'symbols' AS measure, symbols AS value FROM held UNION ALL
  SELECT stratum, quality, 'dup_lines', dup_lines FROM held UNION ALL SELECT stratum, quality, 'repeats', repeats FROM held),
tried AS (
  SELECT stratum, measure, g.cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND value > g.cutoff) AS k,
         count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 0 AND value > g.cutoff) AS caught
  FROM long, (SELECT unnest(range(0, 1000, 25)) AS cutoff) g GROUP BY 1, 2, 3),
hopeful AS (
  SELECT *, (SELECT count(DISTINCT stratum) FROM tried WHERE n > 0) AS strata FROM tried WHERE n > 0 AND k <= floor(n * {ALPHA})),
terms AS (
  SELECT stratum, measure, cutoff, any_value(strata) AS strata, any_value(caught * n - k * bad) AS gain,
         sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}::DOUBLE) + (n - i) * ln(1 - {ALPHA}::DOUBLE))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM hopeful) GROUP BY 1, 2, 3),
best AS (
  SELECT stratum, measure, cutoff, row_number() OVER (PARTITION BY stratum, measure ORDER BY gain DESC, cutoff DESC) AS place
  FROM terms WHERE gain > 0 AND tail <= {DELTA}::DOUBLE / (strata * {len(MEASURES)})),
chosen AS (
  SELECT stratum, max(cutoff) FILTER (WHERE measure = 'symbols') AS cs, max(cutoff) FILTER (WHERE measure = 'dup_lines') AS cd,
         max(cutoff) FILTER (WHERE measure = 'repeats') AS cr
  FROM best WHERE place = 1 GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(symbols > cs, false) OR coalesce(dup_lines > cd, false) OR coalesce(repeats > cr, false)) AS kept
FROM rated LEFT JOIN chosen USING (stratum)
"""
