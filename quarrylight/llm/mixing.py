"""Mixing sources to target weights by capped water-filling.

Built-in functions only. Targets: every source gets the common level times its
weight, clamped at ``max_epochs`` times its size; what the clamp frees goes to
the others by weight until no target is above its clamp. That fixed point is
found in closed form: with sources in ascending order of clamp/weight, the
clamped ones are a prefix.

Taking: a source whose target is r times its size is repeated floor(r) times
whole; the rest of the target is filled with documents in a seeded order, and
the one that crosses the end is taken in part, so each source meets its target
to the word. The seeded order is cut into buckets, ranges of its hashes, more of
them for more rows: only totals of buckets are summed up over a source, and only
inside a bucket are rows ordered. The number of buckets doesn't change the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACES, row_hash

#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a bucket, about, if all were of one source.
PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 if it is null."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(kept, SPACES, "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``sizes`` has source and size. Sources weigh ``weights`` in turn in code
    point order, a null source last. ``share`` of all sizes is given out. If all
    clamps together are less, every source gets its clamp; a source of size 0
    gets 0. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", picked.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("clamp"))
    fill = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    clamped = F.coalesce(F.sum("clamp").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level if those before are clamped rises while they are rightly so, then falls
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - clamped) / left)
    target = F.least("clamp", F.max("level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def seeded_key(doc_id: Column, size: Column, seed: str) -> Column:
    """32 hexadecimal digits, which order the documents of a source."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")))


def _taken(rows: DataFrame, n_rows: int, weights, share: float, max_epochs: float, seed: str) -> DataFrame:
    """Adds source_size, target, whole and taken to rows of doc_id, source, size, tie."""
    rows = rows.withColumn("key", seeded_key(F.col("doc_id"), F.col("size"), seed))
    bits = min(30, max(6, math.ceil(math.log2(max(1, n_rows / PER_BUCKET)))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets, weights, share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    # words of the fractional repetition
    targets = targets.withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b, t = buckets.alias("b"), targets.alias("t")
    spread = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("source"), F.col("b.bucket").alias("bucket"), F.col("b.size").alias("bucket_size"), "source_size", "target", "whole", "quota"
    )
    spread = spread.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r, s = rows.alias("r"), spread.alias("s")
    joined = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - F.col("bucket_start") - F.col("start")))
    return joined.select("r.doc_id", "r.source", "r.size", "r.tie", "s.source_size", "s.target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """Words that the mix takes of every document.

    Returns doc_id, source, size, source_size, target, taken for every row, with
    repeated rows each by itself. A null text and a text without words have size
    0 and nothing is taken of them; a null source is a source. No row gives more
    than ``max_epochs`` times its size. Ties in the seeded order (rows with equal
    doc_id and size) are alike, so any order among them gives the same rows.
    """
    rows = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), F.lit(0).alias("tie"))
    return _taken(rows, docs.count(), weights, share, max_epochs, seed).drop("tie")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    word = r"[^\x20\x09-\x0D]+"
    marked = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{word})"), F.lit(1))
    return F.array_join(F.slice(marked, F.lit(1), n.cast("int")), "")


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed documents: each row as often as it is taken whole, and a part.

    Returns the columns of ``docs``, whatever their names; a part is cut after its
    last word taken, with n_chars, if there is one, set to its length. Documents
    of size 0 (null, empty and wordless texts) can't be taken and are left out.
    Rows that are alike in all columns give together what the mix takes of them;
    rows that share only a doc_id each give their own. No rows: no rows.
    """
    row = F.col("row")
    wide = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), row_hash(docs).alias("tie"))
    taken = _taken(wide.drop("row"), docs.count(), weights, share, max_epochs, seed).filter("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words"), F.col("tie").alias("same")).agg(F.sum("taken").alias("taken"), F.count("*").alias("alike"))
    joined = wide.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words")) & (F.col("tie") == F.col("same"))).select("row", "size", "taken", "id", "same", "alike")
    # one of those that are alike stands for all
    stands = joined.filter("alike > 1").groupBy("id", "size", "same").agg(F.first(F.struct("row", "taken")).alias("f")).select("f.row", "size", "f.taken")
    rows = joined.filter("alike = 1").select("row", "size", "taken").union(stands.select("row", "size", "taken"))
    rest = F.col("taken") % F.col("size")
    copies = F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.select("row", F.explode(F.concat(copies, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("cut"))
    rows = rows.select("row", "cut", F.when(F.col("cut") > 0, first_words(row.getField("text"), F.col("cut"))).otherwise(row.getField("text")).alias("part"))
    new = {"text": F.col("part")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut") > 0, F.length("part")).otherwise(row.getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, row.getField(c)).alias(c) for c in docs.columns])


#: The contract's rows in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size) AS key FROM sized),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS clamp,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(clamp, max(level) OVER () * weight) AS target FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT b.doc_id, b.size, s.source_size, s.target, s.whole, round(s.target - s.whole * s.source_size) AS quota,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed b JOIN split s ON b.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(whole * size + least(size, greatest(0, quota - start)) AS BIGINT) AS taken
FROM placed
"""
