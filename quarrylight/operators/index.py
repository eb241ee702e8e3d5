"""A positional inverted index, and web-style search of many queries over it.

The index is a table of posting rows: one for each lexeme and evidence, with the
lexeme's positions. A frequent lexeme has many rows, not one long list, so no row
grows with the corpus. Queries become a table of clauses, matching is a join of
clauses with postings on the lexeme (evidence that shares no lexeme never moves),
phrases are intersections of shifted position lists, and covers are found by one
pass over the merged positions. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators.retrieval import SearchQuery, lexemes_of
from quarrylight.runtime import durable

CLAUSES = "query_id long, part int, alternative int, negated boolean, lexemes array<string>"
#: Weight of a cover's words, as in the published cover density with one weight.
WEIGHT = 0.4


def text_entries(evidence: DataFrame) -> DataFrame:
    """One entry for each evidence with text: its lexemes in order and a digest.

    Null texts have no entry; a text without a letter or digit has one without
    lexemes. Of evidence that repeats, every row is an entry.
    """
    rows = evidence.filter("content IS NOT NULL").select("evidence_id", "content")
    return rows.select("evidence_id", F.sha2("content", 256).alias("content_hash"), lexemes_of(F.col("content")).alias("lexemes"))


def postings(entries: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """lexeme, evidence_id, positions (from 0, ascending). ``only``: a table with a
    column lexeme; others are dropped before anything is shuffled for them. Without
    it, entries meet by evidence before they are taken apart, so that their lexemes
    are shuffled as lists, and a text's postings arise where it is."""
    if only is None:
        entries = entries.select("evidence_id", "lexemes").repartition("evidence_id")
    rows = entries.select("evidence_id", F.posexplode("lexemes").alias("position", "lexeme"))
    if only is not None:
        rows = rows.join(only.select("lexeme").distinct(), "lexeme", "left_semi")
    return rows.groupBy("lexeme", "evidence_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def write_index(entries: DataFrame, path: str, buckets: int = 64) -> None:
    """Write postings by hash buckets of the lexeme, sorted by it: a search reads
    the buckets of its lexemes, and of these the row groups that hold them."""
    rows = postings(entries).withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("evidence_id"), F.lit(8))).sortWithinPartitions("bucket", "lexeme", "evidence_id").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, clauses: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Postings of an index; with ``clauses`` only of their lexemes."""
    index = spark.read.parquet(path)
    if clauses is None:
        return index.drop("bucket")
    wanted = clauses.select(F.explode("lexemes").alias("lexeme")).distinct()
    keys = wanted.select(F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
    used = [r["bucket"] for r in keys.collect()]  # at most ``buckets`` numbers
    return index.filter(F.col("bucket").isin(used)).join(wanted, "lexeme", "left_semi").drop("bucket")


def clauses_of(queries: DataFrame) -> DataFrame:
    """The clauses of web-style queries (query_id, query): every part of a query
    must hold, one of its alternatives does; a clause is a word or a phrase.

    Blank, null and signs-only queries have no clause, so they match nothing.
    """

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for q, text in zip(pdf["query_id"], pdf["query"], strict=True):
                for p, group in enumerate(SearchQuery.parse(text or "").groups):
                    out += [(q, p, a, negated, list(words)) for a, (words, negated) in enumerate(group)]
            yield pd.DataFrame(out, columns=["query_id", "part", "alternative", "negated", "lexemes"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "query").mapInPandas(parse, CLAUSES)


def clause_hits(clauses: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, part, alternative, evidence_id of every clause that a text holds."""
    words = clauses.select("query_id", "part", "alternative", F.size("lexemes").alias("n"), F.posexplode("lexemes").alias("offset", "lexeme"))
    found = words.join(index, "lexeme").select("query_id", "part", "alternative", "n", "evidence_id", F.transform("positions", lambda p: p - F.col("offset")).alias("starts"))
    key = ["query_id", "part", "alternative", "evidence_id"]
    alone = found.filter("n = 1").select(*key)
    # all words of a phrase, and a start that they share
    phrases = found.filter("n > 1").groupBy(*key, "n").agg(F.collect_list("starts").alias("lists")).filter("size(lists) = n")
    shared = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
    return alone.unionByName(phrases.filter(F.size(shared) > 0).select(*key))


def matching(clauses: DataFrame, index: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, evidence_id) that a query matches.

    A query with a part without negation is decided among the evidence of that
    part's postings. Only queries all of whose parts have a negation are held
    against the whole evidence, and their result is as large.
    """
    hits = clause_hits(clauses, index).withColumn("clause", F.struct("part", "alternative"))
    told = hits.groupBy("query_id", "evidence_id").agg(F.collect_set("clause").alias("held"))
    parts = clauses.groupBy("query_id", "part").agg(F.collect_list(F.struct("part", "alternative", "negated")).alias("some"), F.bool_or("negated").alias("bare"))
    wanted = parts.groupBy("query_id").agg(F.collect_list("some").alias("parts"), (~F.bool_and("bare")).alias("anchored"))
    every = evidence.select("evidence_id").distinct().crossJoin(wanted.filter("NOT anchored").select("query_id")) if wanted.filter("NOT anchored").head(1) else None
    among = told.join(wanted, "query_id").filter("anchored")
    if every is not None:
        among = among.unionByName(every.join(told, ["query_id", "evidence_id"], "left").join(wanted, "query_id").select(among.columns))
    held = F.coalesce("held", F.expr("cast(array() AS array<struct<part:int,alternative:int>>)"))

    def holds(c: Column) -> Column:
        return F.exists(held, lambda h: (h["part"] == c["part"]) & (h["alternative"] == c["alternative"])) != c["negated"]

    return among.filter(F.forall("parts", lambda p: F.exists(p, holds))).select("query_id", "evidence_id")


def cover_scores(clauses: DataFrame, index: DataFrame, matched: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """query_id, evidence_id, score of matched evidence: the sum over minimal covers
    of weight times lexemes per word of the cover.

    A cover is a shortest stretch with every lexeme of the query that isn't
    negated. Evidence that lacks one of them has no row: its score is 0.
    """
    own = clauses.filter("NOT negated").select("query_id", F.explode("lexemes").alias("lexeme")).distinct()
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("lexeme")) - 1).withColumn("of", F.count("*").over(Window.partitionBy("query_id")))
    rows = own.join(index, "lexeme").join(matched, ["query_id", "evidence_id"], "left_semi")
    lists = rows.groupBy("query_id", "evidence_id", "of").agg(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("at"), F.col("k").alias("k"))))).alias("events"), F.count("*").alias("n")).filter("n = of")
    none = F.array_repeat(F.lit(-1), F.col("of").cast("int"))
    start = F.struct(none.alias("last"), F.lit(-1).alias("used"), F.lit(0.0).alias("total"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda v, i: F.when(i == e["k"], e["at"]).otherwise(v))
        begins = F.array_min(last)
        new = begins > acc["used"]
        return F.struct(
            last.alias("last"), F.when(new, begins).otherwise(acc["used"]).alias("used"),
            (acc["total"] + F.when(new, F.lit(weight) * F.col("of") / (e["at"] - begins + 1)).otherwise(0.0)).alias("total"),
        )

    return lists.select("query_id", "evidence_id", F.aggregate(F.array_sort("events"), start, step, lambda acc: acc["total"]).alias("score"))


def search(queries: DataFrame, evidence: DataFrame, index: DataFrame | None = None, limit: int = 20, digits: int = 9) -> DataFrame:
    """The best ``limit`` of each web-style query: query_id, evidence_id,
    exact_match, score, rank.

    Evidence counts that matches, or has a term of the query as an exact term:
    exact ones first, then by cover density (rounded to ``digits``), then by id.
    ``index``: postings, else they are made of the queries' lexemes alone, and
    written, as are the clauses and what matches, so texts are read once.
    """
    from quarrylight.functions.text import query_terms

    clauses = durable(clauses_of(queries), "clauses")
    if index is None:
        index = durable(postings(text_entries(evidence), clauses.select(F.explode("lexemes").alias("lexeme"))), "postings")
    matched = matching(clauses, index, evidence)
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(query_terms(F.col("query"))).alias("term"))
    exact = evidence.select("evidence_id", F.explode("exact_terms").alias("term")).join(wanted, "term").select("query_id", "evidence_id").distinct()
    both = matched.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))
    both = durable(both.groupBy("query_id", "evidence_id").agg(F.bool_or("exact").alias("exact_match")), "matched")
    scored = both.join(cover_scores(clauses, index, both), ["query_id", "evidence_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact_match"), F.desc("score"), "evidence_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "evidence_id", "exact_match", "score", "rank")
