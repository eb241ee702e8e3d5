"""Registered queries over the driver's tables, each with its SQL.

The tables stand in for the engine's record sets: documents are evidence,
embeddings are vector items, line items are facts (an order depends on a part, a
part is supplied by a supplier), orders before and after a date are two snapshots,
events are runs, jobs and observations, labels are expectations.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import content as C
from quarrylight.functions.text import collapse, content_id, normalize_terms, tokens_of_bytes, tokens_of_characters
from quarrylight.functions.vectors import cosine_distance, unit
from quarrylight.operators import candidates as K
from quarrylight.operators import evaluation as E
from quarrylight.operators import expansion as P
from quarrylight.operators import extract as X
from quarrylight.operators import facts as A
from quarrylight.operators import graph as G
from quarrylight.operators import incremental as I
from quarrylight.operators import index as N
from quarrylight.operators import matching as M
from quarrylight.operators import policy as O
from quarrylight.operators import quality as Q
from quarrylight.operators import relations as L
from quarrylight.operators import retrieval as R
from quarrylight.operators import selection as S
from quarrylight.operators import update as U
from quarrylight.runtime import brief_shuffles, discard, durable, shared_dir, table
from quarrylight.sources import datasources as D
from quarrylight.sources import factual as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- retrieval -----------------------------------------------------------------


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence; the source and the language are exact terms."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("content"), normalize_terms(F.array("source", "lang")).alias("exact_terms"), F.sha2("text", 256).alias("content_hash"), "source", "lang")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: every benchmark item whose id divides by 20."""
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), F.lit(" src3 fr")).alias("query"))


def wanted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("vector"), "label")


_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '') || regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_-]+'))"
_TEXT_SQL = f"""
q AS (SELECT item_id AS query_id, unnest({_TERMS.format("text || ' src3 fr'")}) AS term FROM benchmark WHERE item_id % 20 = 0),
t AS (SELECT doc_id AS evidence_id, unnest({_TERMS.format("text")}) AS term, 0 AS exact FROM documents
      UNION ALL SELECT doc_id, unnest(list_distinct([lower(source), lower(lang)])), 1 FROM documents),
hits AS (SELECT query_id, evidence_id, count(*) AS score, max(exact) = 1 AS exact_match FROM t JOIN q USING (term) GROUP BY 1, 2),
text_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, exact_match DESC, evidence_id) AS rank FROM hits)"""
_VECTOR_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (SELECT w.vec_id AS query_id, i.vec_id AS evidence_id,
                 round(least(2, greatest(0, 1 - list_cosine_similarity(w.v, i.v))), 9) AS distance FROM e w, e i WHERE w.vec_id % 20 = 0),
vector_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, evidence_id) AS rank FROM pairs)"""


@query("vector_topk_cosine", f"WITH {_VECTOR_SQL} SELECT query_id, evidence_id, round(distance, 6) AS distance, rank FROM vector_ranked WHERE rank <= 20")
def vector_topk_cosine(spark, sf_dir):
    return R.vector_topk(wanted_vectors(spark, sf_dir), vector_items(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("text_overlap_topk", f"WITH {_TEXT_SQL} SELECT query_id, evidence_id, score, exact_match, rank FROM text_ranked WHERE rank <= 20")
def text_overlap_topk(spark, sf_dir):
    return R.text_overlap(questions(spark, sf_dir), evidence(spark, sf_dir))


@query("exact_match_hits", f"""WITH {_TEXT_SQL} SELECT query_id, evidence_id,
  row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS rank FROM (SELECT DISTINCT query_id, evidence_id FROM t JOIN q USING (term) WHERE exact = 1)""")
def exact_match_hits(spark, sf_dir):
    return R.exact_hits(questions(spark, sf_dir), evidence(spark, sf_dir))


_RRF_SQL = f"""WITH {_TEXT_SQL},{_VECTOR_SQL},
parts AS (SELECT query_id, evidence_id, 'text' AS signal, 1.0::DOUBLE / (60 + rank) AS part FROM text_ranked WHERE rank <= 20
          UNION ALL SELECT query_id, evidence_id, 'vector', 1.0::DOUBLE / (60 + rank) FROM vector_ranked WHERE rank <= 20),
fused AS (SELECT query_id, evidence_id, round(sum(part), 12) AS score, list_sort(list(DISTINCT signal)) AS signals FROM parts GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM fused)"""


def _fused(spark, sf_dir):
    return R.fuse({"text": text_overlap_topk(spark, sf_dir), "vector": QUERIES["vector_topk_cosine"](spark, sf_dir)})


@query("hybrid_rrf", _RRF_SQL + " SELECT query_id, evidence_id, round(score, 9) AS score, array_to_string(signals, ',') AS signals, rank FROM placed WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    """The flagship query: text and vector signals of several questions, fused."""
    return _fused(spark, sf_dir).select("query_id", "evidence_id", F.round("score", 9).alias("score"), F.array_join("signals", ",").alias("signals"), "rank")


@query("candidate_projection", _RRF_SQL + """ SELECT query_id, evidence_id, CASE WHEN list_contains(signals, 'text') OR list_contains(signals, 'vector') THEN 'text' ELSE 'relation' END AS kind,
  round(least(greatest(score, 0.01::DOUBLE), 1.0::DOUBLE), 9) AS relevance FROM placed WHERE rank <= 20""")
def candidate_projection(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "evidence_id", R.candidate_kind(F.col("signals")).alias("kind"), F.round(R.relevance(F.col("score")), 9).alias("relevance"))


@query("retrieval_degradations", f"""WITH {_TEXT_SQL} SELECT item_id AS query_id,
  array_to_string(list_filter(['relation_unavailable', CASE WHEN item_id NOT IN (SELECT query_id FROM hits) THEN 'no_retrieval_candidates' END], lambda x: x IS NOT NULL), ',') AS degradations
  FROM benchmark WHERE item_id % 20 = 0""")
def retrieval_degradations(spark, sf_dir):
    q, hits = questions(spark, sf_dir), text_overlap_topk(spark, sf_dir)
    return R.degradations(q, hits, hits, None).select("query_id", F.array_join("degradations", ",").alias("degradations"))


@query("hash_consistency", """SELECT r.r AS query_id, label AS evidence_id, count(DISTINCT vec_id % 3) AS hashes FROM embeddings, (VALUES (0), (1)) r(r) GROUP BY 1, 2 HAVING count(DISTINCT vec_id % 3) > 1""")
def hash_consistency(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("query_id"), F.col("label").alias("evidence_id"), (F.col("vec_id") % 3).alias("content_hash"))
    return R.inconsistent_hashes(hits)


@query("vector_validation", "SELECT vec_id AS evidence_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'zero_norm' END AS reason FROM embeddings WHERE len(embedding) <> 64 OR list_sum(list_transform(embedding, lambda x: abs(x))) = 0")
def vector_validation(spark, sf_dir):
    return R.validate_vectors(vector_items(spark, sf_dir), 64)


@query("label_centroid_distance", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  first AS (SELECT label, arg_min(v, vec_id) AS c FROM e GROUP BY label)
  SELECT vec_id, round(least(2, greatest(0, 1 - list_cosine_similarity(v, c))), 6) AS distance, round(list_sum(list_transform(v, lambda x: x * x / list_sum(list_transform(v, lambda y: y * y)))), 6) AS unit_norm FROM e JOIN first USING (label)""")
def label_centroid_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    squares = F.aggregate(unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x)
    return e.join(first, "label").select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("c")), 6).alias("distance"), F.round(squares, 6).alias("unit_norm"))


def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two web-style queries for each benchmark item whose id divides by 20, made of
    its first words: phrases, alternatives, a negation; and an exact term."""
    b = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select("item_id", R.lexemes_of(F.col("text")).alias("w"))
    w = [F.get("w", F.lit(i)) for i in range(5)]
    both = F.array(
        F.struct((F.col("item_id") * 2).alias("query_id"), F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" or '), w[2], F.lit(" "), w[3], F.lit(" -"), w[4]).alias("query")),
        F.struct((F.col("item_id") * 2 + 1).alias("query_id"), F.concat(F.lit("src3 or "), w[0]).alias("query")),
    )
    return b.select(F.inline(both))


_LEXEMES = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("full_text_search", f"""WITH b AS (SELECT item_id * 2 AS q, {_LEXEMES} AS w FROM benchmark WHERE item_id % 20 = 0),
  c AS (SELECT q, 0 AS part, false AS neg, [w[1], w[2]] AS lex FROM b UNION ALL SELECT q, 0, false, [w[3]] FROM b UNION ALL SELECT q, 1, false, [w[4]] FROM b UNION ALL SELECT q, 2, true, [w[5]] FROM b
        UNION ALL SELECT q + 1, 0, false, ['src3'] FROM b UNION ALL SELECT q + 1, 0, false, [w[1]] FROM b),
  s AS (SELECT q, '"' || w[1] || ' ' || w[2] || '" or ' || w[3] || ' ' || w[4] || ' -' || w[5] AS text FROM b UNION ALL SELECT q + 1, 'src3 or ' || w[1] FROM b),
  d AS (SELECT doc_id, {_LEXEMES} AS w FROM documents WHERE text IS NOT NULL),
  parts AS (SELECT q, doc_id, part, bool_or(contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(lex, ' ') || ' ') <> neg) AS ok FROM c, d GROUP BY 1, 2, 3),
  m AS (SELECT q, doc_id FROM parts GROUP BY 1, 2 HAVING bool_and(ok)),
  x AS (SELECT DISTINCT q, doc_id FROM (SELECT q, unnest({_TERMS.format("text")}) AS term FROM s) JOIN (SELECT doc_id, unnest([lower(source), lower(lang)]) AS term FROM documents) USING (term)),
  u AS (SELECT q, doc_id, bool_or(e) AS exact_match FROM (SELECT q, doc_id, false AS e FROM m UNION ALL SELECT q, doc_id, true FROM x) GROUP BY 1, 2),
  o AS (SELECT DISTINCT q, unnest(lex) AS word FROM c WHERE NOT neg), k AS (SELECT q, count(*) AS k FROM o GROUP BY 1),
  p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d), e AS (SELECT q, doc_id, word, pos FROM p JOIN o USING (word) JOIN u USING (q, doc_id)),
  nxt AS (SELECT a.q, a.doc_id, a.pos, z.word, min(z.pos) AS p FROM e a JOIN e z ON a.q = z.q AND a.doc_id = z.doc_id AND z.pos >= a.pos GROUP BY 1, 2, 3, 4),
  ends AS (SELECT q, doc_id, pos, max(p) AS till FROM nxt GROUP BY 1, 2, 3 HAVING count(*) = (SELECT k FROM k WHERE k.q = nxt.q)),
  cov AS (SELECT q, doc_id, till, max(pos) AS since FROM ends GROUP BY 1, 2, 3),
  r AS (SELECT q, doc_id, sum(0.4::DOUBLE * k / (till - since + 1)) AS score FROM cov JOIN k USING (q) GROUP BY 1, 2),
  v AS (SELECT q AS query_id, doc_id AS evidence_id, exact_match, round(coalesce(score, 0), 9) AS score FROM u LEFT JOIN r USING (q, doc_id))
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, score DESC, evidence_id) AS rank FROM v) WHERE rank <= 200""")
def full_text_search(spark, sf_dir):
    return N.search(web_queries(spark, sf_dir), evidence(spark, sf_dir), limit=200)


@query("text_entries", f"""SELECT word AS lexeme, count(*) AS documents, sum(n) AS occurrences, sum(first) AS first FROM (
  SELECT doc_id, word, count(*) AS n, min(pos) - 1 AS first FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_LEXEMES} AS w FROM documents)) GROUP BY 1, 2) GROUP BY 1""")
def text_entries(spark, sf_dir):
    """The inverted index of all texts, summed up for each lexeme."""
    index = N.postings(N.text_entries(evidence(spark, sf_dir)))
    return index.groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"), F.sum(F.element_at("positions", 1)).alias("first"))


_SCOPED_SQL = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  p AS (SELECT w.vec_id AS query_id, i.vec_id AS evidence_id, round(least(2, greatest(0, 1 - list_cosine_similarity(w.v, i.v))), 9) AS distance FROM e w JOIN e i ON w.label = i.label AND w.vec_id % 3 = i.vec_id % 3 WHERE w.vec_id % 20 = 0 AND i.vec_id % 4 <> 1)"""


@query("vector_scoped_topk", f"WITH {_SCOPED_SQL} SELECT query_id, evidence_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, evidence_id) AS rank FROM p) WHERE rank <= 20")
def vector_scoped_topk(spark, sf_dir):
    """Neighbours in the same scope (label) and profile, among items that are ready."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("scope"), (F.col("vec_id") % 3).alias("profile"), F.when(F.col("vec_id") % 4 == 1, "stale").otherwise("ready").alias("state"))
    own = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return R.vector_topk(own, e.withColumnRenamed("vec_id", "evidence_id"), within=("scope", "profile"), state="ready").withColumn("distance", F.round("distance", 6))


# --- facts and graph -------------------------------------------------------------


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item says of a part who supplies it; the return flag tells who says so."""
    li = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("part-"), F.col("l_partkey")), F.concat(F.lit("supplier-"), F.col("l_suppkey"))
    return li.select(
        F.concat_ws("-", F.lit("f"), "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_linestatus").alias("scope"), F.lit("definition").alias("predicate"),
        F.lit("symbol").alias("subject_kind"), part.alias("subject_id"), F.lit("symbol").alias("object_kind"), supplier.alias("object_id"), supplier.alias("assertion"),
        F.col("l_returnflag").alias("producer"), F.col("l_orderkey").alias("order"), "l_partkey", "l_suppkey",
    )


_FACTS_SQL = """facts AS (SELECT concat_ws('-', 'f', l_orderkey, l_linenumber) AS fact_id, l_linestatus AS scope, 'definition' AS predicate,
  'part-' || l_partkey AS subject_id, 'supplier-' || l_suppkey AS object_id, l_returnflag AS producer, l_orderkey, l_partkey, l_suppkey FROM lineitem)"""


@query("fact_conflicts", f"""WITH {_FACTS_SQL} SELECT scope, subject_id, count(DISTINCT object_id) AS assertions, count(DISTINCT producer) AS producers, count(DISTINCT fact_id) AS facts
  FROM facts GROUP BY 1, 2 HAVING count(DISTINCT object_id) >= 2 AND count(DISTINCT producer) >= 2""")
def fact_conflicts(spark, sf_dir):
    return A.conflicts(line_facts(spark, sf_dir)).select("scope", "subject_id", "assertions", "producers", F.size("fact_ids").cast("long").alias("facts"))


@query("membership_unique", f"""WITH {_FACTS_SQL} SELECT scope, subject_id AS symbol, min(object_id) AS artifact, min(fact_id) AS fact_id FROM facts GROUP BY 1, 2 HAVING count(DISTINCT object_id) = 1""")
def membership_unique(spark, sf_dir):
    f = line_facts(spark, sf_dir)
    return A.unique_membership(f.select("scope", F.col("subject_id").alias("symbol"), F.col("object_id").alias("artifact"), "fact_id"))


@query("entity_projection", f"""WITH {_FACTS_SQL}, sides AS (SELECT scope, subject_id AS id, fact_id FROM facts UNION ALL SELECT scope, object_id, fact_id FROM facts)
  SELECT scope, id, count(DISTINCT fact_id) AS facts FROM sides GROUP BY 1, 2""")
def entity_projection(spark, sf_dir):
    return L.entities_of(line_facts(spark, sf_dir)).select("scope", "id", "facts")


@query("relation_projection", f"""WITH {_FACTS_SQL} SELECT scope, subject_id, object_id, array_to_string(list_sort(list(DISTINCT fact_id)), ',') AS fact_ids FROM facts GROUP BY 1, 2, 3""")
def relation_projection(spark, sf_dir):
    return L.relations_of(line_facts(spark, sf_dir)).select("scope", "subject_id", "object_id", F.array_join("fact_ids", ",").alias("fact_ids"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return li.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("from_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("to_id"), F.lit("supplied_by").alias("type")).withColumn("edge_id", F.concat_ws(">", "from_id", "to_id"))


_EDGES_SQL = "edges AS (SELECT DISTINCT 'p' || l_partkey AS from_id, 's' || l_suppkey AS to_id, 'supplied_by' AS type, 'p' || l_partkey || '>' || 's' || l_suppkey AS edge_id FROM lineitem)"


@query("relation_one_hop", f"""WITH {_EDGES_SQL}, anchors AS (SELECT 's' || s_suppkey AS anchor FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT 'p' || p_partkey FROM part WHERE p_partkey % 20 = 0),
  hits AS (SELECT anchor, edges.* FROM edges JOIN anchors ON from_id = anchor UNION SELECT anchor, edges.* FROM edges JOIN anchors ON to_id = anchor),
  placed AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY from_id, to_id, type, edge_id) AS position FROM hits)
  SELECT anchor, edge_id, from_id, to_id, type, position FROM placed WHERE position <= 25""")
def relation_one_hop(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("anchor"))
    p = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("anchor"))
    return L.one_hop(s.union(p), supply_edges(spark, sf_dir))


@query("dependency_composition", """WITH d AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), e AS (SELECT DISTINCT l_partkey AS b, l_suppkey AS c FROM lineitem)
  SELECT a AS src, c AS dst, count(*) AS paths FROM d JOIN e USING (b) GROUP BY 1, 2""")
def dependency_composition(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return G.composition(li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("via")), li.select(F.col("l_partkey").alias("via"), F.col("l_suppkey").alias("dst")), li.count())


def binary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as derivations: each from the customer with half its number."""
    return table(spark, sf_dir, "customer").filter("c_custkey > 1").select(F.floor(F.col("c_custkey") / 2).cast("long").alias("src"), F.col("c_custkey").alias("dst"))


_TREE_SQL = "e AS (SELECT c_custkey // 2 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 1)"
_CLOSURE_SQL = f"""WITH RECURSIVE {_TREE_SQL}, c AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src)"""


@query("dependency_transitive", _CLOSURE_SQL + " SELECT DISTINCT src, dst FROM c WHERE src <> dst")
def dependency_transitive(spark, sf_dir):
    return G.transitive_closure(binary_tree(spark, sf_dir))


@query("lineage_dependents", _CLOSURE_SQL + " SELECT src AS root, dst AS node, min(depth) AS depth FROM c WHERE src <> dst AND src % 20 = 0 GROUP BY 1, 2")
def lineage_dependents(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("node"))
    return G.reachable(roots, binary_tree(spark, sf_dir))


@query("lineage_support", _CLOSURE_SQL + " SELECT dst AS root, src AS node, min(depth) AS depth FROM c WHERE src <> dst AND dst % 20 = 0 GROUP BY 1, 2")
def lineage_support(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("node"))
    return G.reachable(roots, binary_tree(spark, sf_dir), forward=False)


@query("invalidation_fanout", _CLOSURE_SQL + """ SELECT dst AS fact_id, min(depth) AS depth, array_to_string(list_sort(list(DISTINCT CASE WHEN src % 40 = 0 THEN 'changed' ELSE 'removed' END)), ',') AS reasons
  FROM c WHERE src % 20 = 0 AND src <> dst GROUP BY 1""")
def invalidation_fanout(spark, sf_dir):
    changed = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("fact_id"), F.when(F.col("c_custkey") % 40 == 0, "changed").otherwise("removed").alias("reason"))
    out = G.invalidated(changed, binary_tree(spark, sf_dir).select(F.col("src").alias("input_id"), F.col("dst").alias("fact_id")))
    return out.select("fact_id", "depth", F.array_join("reasons", ",").alias("reasons"))


@query("lineage_acyclic", "SELECT 0 AS cyclic")
def lineage_acyclic(spark, sf_dir):
    return G.cyclic_nodes(binary_tree(spark, sf_dir)).agg(F.count("*").cast("int").alias("cyclic"))


@query("direct_dependents", f"WITH {_TREE_SQL} SELECT DISTINCT dst AS path FROM e WHERE src % 20 = 0")
def direct_dependents(spark, sf_dir):
    changed = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("path"))
    return G.direct_dependents(changed, binary_tree(spark, sf_dir).select(F.col("dst").alias("path"), F.col("src").alias("depends_on")))


@query("derivation_fixpoint", """WITH RECURSIVE n AS (SELECT DISTINCT c_nationkey AS a FROM customer), e AS (SELECT a AS src, a + 1 AS dst FROM n WHERE a < 24),
  c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c""")
def derivation_fixpoint(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src")).distinct().filter("src < 24").withColumn("dst", F.col("src") + 1)
    base = n.withColumn("fact_id", content_id("fact", F.col("src"), F.col("dst")))

    def transitive(known: DataFrame) -> DataFrame:
        two = known.alias("x").join(known.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).filter("src <> dst").distinct()
        return two.withColumn("fact_id", content_id("fact", F.col("src"), F.col("dst")))

    return G.derive(base, [("transitive", transitive)]).facts.select("src", "dst")


def expansion_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, seeds and references: a query is a supplier, its candidates are
    the ten orders that take most of it, an order's entities are its parts."""
    li = table(spark, sf_dir, "lineitem")
    own = li.filter("l_suppkey % 20 = 0").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("evidence_id")).agg(F.round(F.sum("l_quantity") / 1000, 6).alias("score"))
    fused = durable(R.ranked(own, F.desc("score"), F.asc("evidence_id"), limit=10), "fused")
    parts = li.select(F.col("l_orderkey").alias("evidence_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("entity"))
    suppliers = li.select(F.col("l_orderkey").alias("evidence_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("entity"))
    return fused, fused.join(parts, "evidence_id").distinct(), parts.union(suppliers)


def _expansion_sql(budget: int) -> str:
    """Seed after seed with what is left of the budget."""
    return f"""WITH RECURSIVE {_EDGES_SQL},
  own AS (SELECT l_suppkey AS query_id, l_orderkey AS evidence_id, round(sum(l_quantity) / 1000, 6) AS score FROM lineitem WHERE l_suppkey % 20 = 0 GROUP BY 1, 2),
  fused AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) <= 10),
  parts AS (SELECT DISTINCT l_orderkey AS evidence_id, 'p' || l_partkey AS entity FROM lineitem),
  refs AS (SELECT entity, evidence_id FROM parts UNION ALL SELECT DISTINCT 's' || l_suppkey, l_orderkey FROM lineitem),
  seeds AS (SELECT query_id, evidence_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id, entity) AS n FROM fused JOIN parts USING (evidence_id)),
  hits AS (SELECT from_id AS anchor, edge_id, to_id AS target, row_number() OVER (PARTITION BY from_id ORDER BY from_id, to_id, type, edge_id) AS position FROM edges QUALIFY position <= 25),
  sizes AS (SELECT anchor, count(*) AS h, sum(r) AS r FROM (SELECT anchor, edge_id, (SELECT count(*) FROM refs WHERE entity = target) AS r FROM hits) GROUP BY 1),
  walk AS (SELECT query_id, 0::BIGINT AS n, {budget}::BIGINT AS room, {budget}::BIGINT AS after, 0::BIGINT AS kept, 0::BIGINT AS before FROM (SELECT DISTINCT query_id FROM seeds)
    UNION ALL SELECT w.query_id, s.n, w.after, w.after - least(z.h, w.after) - least(z.r, w.after - least(z.h, w.after)), least(z.r, w.after - least(z.h, w.after)), w.before + w.kept
    FROM walk w JOIN seeds s ON s.query_id = w.query_id AND s.n = w.n + 1 JOIN sizes z ON z.anchor = s.entity),
  got AS (SELECT w.query_id, s.evidence_id AS seed, h.edge_id, r.evidence_id, w.before, w.kept, row_number() OVER (PARTITION BY w.query_id, w.n ORDER BY h.position, r.evidence_id) AS nth
    FROM walk w JOIN seeds s ON s.query_id = w.query_id AND s.n = w.n JOIN hits h ON h.anchor = s.entity JOIN refs r ON r.entity = h.target WHERE w.kept > 0),
  ranks AS (SELECT *, before + nth AS rank FROM got WHERE nth <= kept),
  once AS (SELECT query_id, seed, edge_id, evidence_id, min(rank) AS rank FROM ranks GROUP BY 1, 2, 3, 4),
  every AS (SELECT query_id, evidence_id, score AS part, 0 AS one FROM fused UNION ALL SELECT query_id, evidence_id, 1.0::DOUBLE / (60 + rank), 1 FROM once),
  total AS (SELECT query_id, evidence_id, round(sum(part), 12) AS score, sum(one) AS relations FROM every GROUP BY 1, 2)
  SELECT query_id, evidence_id, round(score, 9) AS score, relations, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM total) WHERE rank <= 50"""


def _expanded(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    fused, seeds, references = expansion_inputs(spark, sf_dir)
    out = P.expand_and_fuse(fused, seeds, supply_edges(spark, sf_dir), references, budget, limit=50)
    return out.withColumn("score", F.round("score", 9))


@query("relation_expansion", _expansion_sql(500))
def relation_expansion(spark, sf_dir):
    """A budget that ends within the seeds."""
    return _expanded(spark, sf_dir, 500)


@query("relation_expansion_wide", _expansion_sql(10_000_000))
def relation_expansion_wide(spark, sf_dir):
    """A budget that no query uses up."""
    return _expanded(spark, sf_dir, 10_000_000)


# --- content, policy, selection -----------------------------------------------------

_RE = {k: v.replace("'", "''") for k, v in (("secret", C.SECRET), ("auth", C.AUTHORIZATION), ("prompt", C.INJECTION), ("binary", C.BINARY))}
_INSPECT_SQL = f"""i AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] WHEN regexp_matches(text, '{_RE["binary"]}') THEN ['binary'] ELSE list_sort(list_distinct(
    CASE WHEN regexp_matches(text, '{_RE["secret"]}') THEN ['secret_assignment', 'secret'] ELSE [] END || CASE WHEN regexp_matches(text, '{_RE["auth"]}') THEN ['authorization', 'bearer'] ELSE [] END
    || CASE WHEN contains(lower(text), 'private key') OR contains(lower(text), 'private_key') THEN ['pem_private_key', 'secret'] ELSE [] END || CASE WHEN regexp_matches(text, '{_RE["prompt"]}') THEN ['prompt_injection'] ELSE [] END)) END AS f FROM documents),
k AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'safe_text' WHEN regexp_matches(text, '{_RE["binary"]}') THEN 'binary' WHEN len(list_filter(f, lambda x: x <> 'prompt_injection')) > 0 THEN 'sensitive'
  WHEN len(f) > 0 THEN 'prompt_injection' ELSE 'safe_text' END AS kind FROM i)"""


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").withColumn("f", C.findings(F.col("text")))
    rows = rows.withColumn("kind", C.classify(F.col("text"), F.col("f")))
    return rows.withColumn("state", C.content_state(F.col("text"), F.col("kind")))


@query("content_inspection", f"WITH {_INSPECT_SQL} SELECT doc_id, kind, array_to_string(f, ',') AS findings FROM k")
def content_inspection(spark, sf_dir):
    return inspected(spark, sf_dir).select("doc_id", "kind", F.array_join("f", ",").alias("findings"))


@query("policy_resolution", f"""WITH {_INSPECT_SQL} SELECT doc_id, CASE WHEN kind IN ('sensitive', 'prompt_injection') THEN 'redact' WHEN kind = 'binary' THEN 'deny' ELSE 'allow' END AS persist,
  'deny' AS transfer, CASE WHEN kind IN ('sensitive', 'prompt_injection') THEN 10 WHEN kind = 'binary' THEN NULL ELSE nullif(strlen(text), 0) END AS kept_bytes FROM k""")
def policy_resolution(spark, sf_dir):
    rows = inspected(spark, sf_dir).withColumn("persist", C.strictest(F.lit("allow"), C.floor_of(F.col("kind"), 0)))
    kept = C.represent(F.col("text"), F.col("state"), F.col("persist"))
    return rows.select("doc_id", "persist", C.strictest(F.lit("deny"), C.floor_of(F.col("kind"), 1)).alias("transfer"), F.octet_length(kept).cast("long").alias("kept_bytes"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS by_bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS by_characters FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens_of_bytes(F.col("text")).alias("by_bytes"), tokens_of_characters(F.col("text")).alias("by_characters"))


@query("evidence_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS evidence_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def evidence_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("evidence_id"), F.count("*").alias("copies"))


@query("artifact_cap", "SELECT source, doc_id, position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS position FROM documents) WHERE position <= 8")
def artifact_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("artifact_id"), F.col("n_chars").alias("line"), F.col("doc_id").alias("evidence_id"))
    return X.capped_evidence(d).select(F.col("artifact_id").alias("source"), F.col("evidence_id").alias("doc_id"), "position")


def package_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = text_overlap_topk(spark, sf_dir)
    ev = evidence(spark, sf_dir).select("evidence_id", "content", "content_hash", F.col("source").alias("artifact_id"), F.col("lang").alias("kind"))
    return hits.select("query_id", "evidence_id", F.col("score").cast("double").alias("score"), "rank").join(ev, "evidence_id")


@query("package_compose")
def package_compose(spark, sf_dir):
    return S.compose(package_candidates(spark, sf_dir), S.PackageLimits(units=10, tokens=4096, per_artifact=2, per_type=6))


@query("greedy_select")
def greedy_select(spark, sf_dir):
    c = package_candidates(spark, sf_dir)
    items = c.select(
        "query_id", F.col("evidence_id").alias("item_id"), "kind", "artifact_id", (F.col("score") / 100).alias("relevance"), "rank", F.array("kind", "artifact_id").alias("aspects"),
        F.col("content_hash").alias("redundancy_key"), tokens_of_bytes(F.col("content")).alias("tokens"), F.char_length("content").cast("long").alias("characters"), F.octet_length("content").cast("long").alias("bytes"),
    )
    return S.greedy_select(items)


@query("support_closure")
def support_closure(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rel = li.groupBy(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("relation_id")).agg(
        F.sum("l_quantity").alias("score"), F.min("l_orderkey").alias("rank"), F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey")))).alias("needs"), F.lit(10).alias("tokens")
    )
    parts = li.select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("item_id")).distinct().withColumn("tokens", F.lit(20))
    return S.support_closure(rel, parts, parts.join(table(spark, sf_dir, "part").filter("p_size = 10"), F.expr("item_id = concat('p', p_partkey)"), "left_semi"))


@query("abstention_decision", """SELECT doc_id, CASE WHEN n_chars % 5 = 0 AND doc_id % 2 = 1 THEN 'transfer_prohibited' WHEN n_chars % 5 = 0 THEN 'no_transferable_evidence'
  WHEN lang <> 'en' AND lang <> '' THEN 'kind_mismatch' WHEN n_chars < 1000 THEN 'insufficient_support' END AS reason FROM documents""")
def abstention_decision(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    level = F.when(F.col("n_chars") < 1000, "insufficient").otherwise("sufficient")
    return d.select("doc_id", S.abstention(F.col("n_chars") % 5, F.col("doc_id") % 2, F.col("lang"), F.lit("en"), level).alias("reason"))


@query("spend_budget", """WITH RECURSIVE c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, event_id, n, CASE WHEN value <= 300 THEN value ELSE 0 END AS total, CASE WHEN value <= 300 THEN 1 ELSE 0 END AS used, value <= 300 AS admitted FROM c WHERE n = 1
        UNION ALL SELECT c.user_id, c.event_id, c.n, CASE WHEN f.total + value <= 300 AND used < 8 THEN f.total + value ELSE f.total END, CASE WHEN f.total + value <= 300 AND used < 8 THEN used + 1 ELSE used END, f.total + value <= 300 AND used < 8
        FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
  SELECT event_id, round(total, 4) AS total, admitted FROM f""")
def spend_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("account"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("cost"))
    return S.spend(e, 300, requests=8).select("event_id", F.round("total", 4).alias("total"), "admitted")


@query("continuation_page", """SELECT * FROM (SELECT c_mktsegment AS query_id, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place BETWEEN 11 AND 20""")
def continuation_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("query_id", F.col("c_mktsegment"))
    return S.Continuation.page(c, 10, 10, F.desc("c_acctbal"), F.asc("c_custkey")).select("query_id", "c_custkey", "place")


# --- incremental ----------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' orders before a date and all of them: keys are customers and
    priorities, digests the number of orders and their price."""
    o = table(spark, sf_dir, "orders")

    def shot(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("key")).agg(F.concat_ws(":", F.count("*"), F.round(F.sum("o_totalprice") * 100).cast("long")).alias("digest"))

    return shot(o.filter("o_orderdate < timestamp'1996-01-01'")), shot(o.filter("o_orderdate >= timestamp'1993-01-01'"))


_SHOT = "SELECT o_orderpriority AS kind, o_custkey AS key, count(*) || ':' || CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS digest FROM orders WHERE {} GROUP BY 1, 2"
_DIFF_SQL = f"""a AS ({_SHOT.format("o_orderdate < TIMESTAMP '1996-01-01'")}), b AS ({_SHOT.format("o_orderdate >= TIMESTAMP '1993-01-01'")}),
diff AS (SELECT kind, key, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'reused' ELSE 'changed' END AS status FROM a FULL JOIN b USING (kind, key))"""


@query("snapshot_diff", f"WITH {_DIFF_SQL} SELECT * FROM diff")
def snapshot_diff(spark, sf_dir):
    return I.snapshot_diff(*snapshots(spark, sf_dir))


@query("work_saved", f"""WITH {_DIFF_SQL} SELECT kind, count(*) FILTER (WHERE status = 'reused') AS reused, count(*) FILTER (WHERE status = 'changed') AS changed,
  count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed FROM diff GROUP BY 1""")
def work_saved(spark, sf_dir):
    return I.work_saved(snapshot_diff(spark, sf_dir))


@query("projection_impact", f"""WITH {_DIFF_SQL}, r AS (SELECT key AS depends_on, max(CASE WHEN status IN ('changed', 'added') THEN 1 WHEN status = 'removed' THEN 2 ELSE 0 END) AS r FROM diff GROUP BY 1),
  d AS (SELECT c_mktsegment AS projection, c_nationkey AS key, max(coalesce(r, 0)) AS r FROM customer LEFT JOIN r ON c_custkey = depends_on GROUP BY 1, 2)
  SELECT projection, key, CASE r WHEN 2 THEN 'removed' WHEN 1 THEN 'affected' ELSE 'reusable' END AS status FROM d""")
def projection_impact(spark, sf_dir):
    deps = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("projection"), F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("depends_on"))
    return I.projection_impact(snapshot_diff(spark, sf_dir), deps)


@query("ambiguous_keys", """WITH a AS (SELECT CAST(floor(c_acctbal) AS BIGINT) AS key, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT CAST(floor(s_acctbal) AS BIGINT) AS key, count(*) AS n FROM supplier GROUP BY 1)
  SELECT key, CASE WHEN coalesce(a.n, 0) = 1 AND coalesce(b.n, 0) = 1 THEN 1 ELSE coalesce(a.n, 0) + coalesce(b.n, 0) END AS rows, coalesce(a.n, 0) = 1 AND coalesce(b.n, 0) = 1 AS matched FROM a FULL JOIN b USING (key)""")
def ambiguous_keys(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("n").alias("kind"), F.floor("c_acctbal").alias("key"), F.col("c_custkey").cast("string").alias("digest"))
    b = table(spark, sf_dir, "supplier").select(F.lit("n").alias("kind"), F.floor("s_acctbal").alias("key"), F.col("s_suppkey").cast("string").alias("digest"))
    return I.snapshot_diff(a, b).groupBy("key").agg(F.count("*").alias("rows"), F.bool_or(F.col("status").isin("reused", "changed")).alias("matched"))


@query("embedding_cache_missing", """WITH c AS (SELECT label AS h, min(vec_id) AS item_id FROM embeddings WHERE vec_id % 2 = 0 AND label < 6 GROUP BY 1)
  SELECT doc_id, CASE WHEN c.item_id IS NOT NULL THEN 'cache' WHEN doc_id % 10 = 7 THEN 'supplied' ELSE 'missing' END AS origin, c.item_id FROM documents LEFT JOIN c ON doc_id % 10 = c.h""")
def embedding_cache_missing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cache = e.select(F.when(F.col("label") < 6, "p").otherwise("q").alias("profile_id"), F.col("label").cast("long").alias("content_hash"), F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 2 == 0, "ready").otherwise("stale").alias("state"), F.col("embedding").alias("vector"))
    supplied = spark.createDataFrame([(7, [1.0, 0.0])], "content_hash long, vector array<float>")
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("content_hash"))
    return I.embedding_rebuild(asked, cache, supplied, "p").select("doc_id", "origin", "item_id")


@query("job_claim_order", """SELECT queue, job_id, place, attempt FROM (SELECT o_orderpriority AS queue, o_orderkey AS job_id, o_custkey + 1 AS attempt, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place
  FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1996-01-01'))""")
def job_claim_order(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_orderdate").alias("lease_until"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("attempt"))
    return I.claim_order(jobs, F.expr("timestamp'1996-01-01'")).select("queue", "job_id", "place", "attempt")


@query("scan_limits", """WITH f AS (SELECT c_mktsegment AS root, c_name AS path, CAST(floor(abs(c_acctbal)) AS BIGINT) AS size FROM customer),
  r AS (SELECT *, row_number() OVER w AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM f WINDOW w AS (PARTITION BY root ORDER BY path)),
  b AS (SELECT *, max(CASE WHEN place > 50 OR size > 9900 OR total > 200000 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY path ROWS UNBOUNDED PRECEDING) AS broken FROM r)
  SELECT root, path, size, place FROM b WHERE broken = 0""")
def scan_limits(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("root"), F.col("c_name").alias("path"), F.floor(F.abs("c_acctbal")).cast("long").alias("size"))
    return I.limited_walk(files, 50, 9_900, 200_000).select("root", "path", "size", "place")


@query("content_digest", """SELECT source, sha256(string_agg(strlen(k) || ':' || k || strlen(v) || ':' || v, '' ORDER BY k, v)) AS digest, count(*) AS n FROM (SELECT source, CAST(doc_id AS VARCHAR) AS k, sha256(text) AS v FROM documents) GROUP BY 1""")
def content_digest(spark, sf_dir):
    return A.ordered_digest(table(spark, sf_dir, "documents"), ["source"], F.col("doc_id").cast("string"), F.sha2("text", 256))


@query("content_identity", """SELECT p_partkey, 'artifact-' || sha256(strlen(trim(p_name)) || ':' || trim(p_name) || strlen(trim(p_brand)) || ':' || trim(p_brand)) AS id, regexp_replace(lower(trim(p_type)), '\\s+', ' ', 'g') AS kind FROM part""")
def content_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", content_id("artifact", F.col("p_name"), F.col("p_brand")).alias("id"), collapse(F.col("p_type")).alias("kind"))


# --- joins of the relational projection ---------------------------------------------------


@query("semi_rule_usage", "SELECT DISTINCT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_rule_usage(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("left_observation", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def left_observation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("relation_seed_join", """SELECT n_name, r_name, count(*) AS facts, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def relation_seed_join(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    out = t["lineitem"].filter("l_returnflag = 'R'").join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("n_name", "r_name").agg(F.count("*").alias("facts"), F.count_distinct("l_partkey").alias("parts"))


@query("json_observation", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_observation(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("referential_integrity", "SELECT count(*) AS broken FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def referential_integrity(spark, sf_dir):
    return A.missing(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer"), "c_custkey").agg(F.count("*").alias("broken"))


@query("unique_basename", """WITH f AS (SELECT DISTINCT p_brand || '/' || p_name AS path, p_name AS base FROM part), u AS (SELECT base, min(path) AS path FROM f GROUP BY 1 HAVING count(*) = 1)
  SELECT p_partkey, u.path AS resolved FROM part LEFT JOIN u ON base = p_name""")
def unique_basename(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.concat_ws("/", "p_brand", "p_name").alias("path")).distinct()
    return E.unique_by_name(p.select("p_partkey", F.col("p_name").alias("target")), files).select("p_partkey", "resolved")


@query("link_extraction", """SELECT page_id, unnest(range(len(l))) AS position, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def link_extraction(spark, sf_dir):
    return X.link_lines(table(spark, sf_dir, "pages")).select("page_id", F.col("position").cast("long").alias("position"), "href")


# --- evaluation ------------------------------------------------------------------------------

_RUNS_SQL = """runs AS (SELECT event_id, user_id AS case_id, event_type AS variant, value, event_id % 7 AS seven FROM events)"""


@query("recall_precision_at_k", """WITH x AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS evidence_id FROM lineitem), r AS (SELECT l_orderkey AS case_id, l_partkey AS evidence_id, l_linenumber AS rank FROM lineitem WHERE l_quantity > 20),
  w AS (SELECT case_id, count(*) AS expected FROM x GROUP BY 1), f AS (SELECT case_id, evidence_id, min(rank) AS rank FROM r WHERE rank <= 3 GROUP BY 1, 2),
  g AS (SELECT case_id, count(*) AS got, min(rank) AS first_hit FROM f GROUP BY 1)
  SELECT case_id, round(coalesce(got, 0) / CAST(expected AS DOUBLE), 6) AS recall, CASE WHEN got > 0 THEN 1.0::DOUBLE END AS precision, coalesce(first_hit, -1) AS first_hit FROM w LEFT JOIN g USING (case_id)""")
def recall_precision_at_k(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("evidence_id"), F.col("l_linenumber").alias("rank"), "l_quantity")
    out = E.retrieval_metrics(li, li.filter("l_quantity > 20"), 3)
    return out.select("case_id", F.round("recall", 6).alias("recall"), "precision", "first_hit")


@query("metric_distribution", """SELECT event_type, count(value) AS count, min(value) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY 1""")
def metric_distribution(spark, sf_dir):
    out = E.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "count", "min", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "max", F.round("stddev", 6).alias("stddev"))


@query("efficiency_per_success", """SELECT event_type, user_id % 5 AS g, count(*) AS attempted, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS successful,
  round(CASE WHEN sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) > 0 THEN sum(value) / sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) END, 6) AS per_success FROM events GROUP BY 1, 2""")
def efficiency_per_success(spark, sf_dir):
    runs = table(spark, sf_dir, "events").withColumns({"g": F.col("user_id") % 5, "success": F.col("event_id") % 3 == 0, "observer": F.lit("o")})
    return E.per_success(runs, ["event_type", "g"], "value").withColumn("per_success", F.round("per_success", 6))


@query("variant_savings", """WITH r AS (SELECT o_custkey AS case_id, o_orderpriority AS variant, sum(o_totalprice) AS m, bool_and(o_orderstatus <> 'P') AS s FROM orders GROUP BY 1, 2), b AS (SELECT case_id, m AS bm, s AS bs FROM r WHERE variant = '1-URGENT'),
  j AS (SELECT case_id, variant, m, bm, CASE WHEN bs IS NULL THEN 'baseline_missing' WHEN NOT bs THEN 'baseline_unsuccessful' WHEN NOT s THEN 'candidate_unsuccessful' END AS reason FROM r LEFT JOIN b USING (case_id) WHERE variant <> '1-URGENT')
  SELECT case_id, variant, reason IS NULL AS comparable, reason, round(CASE WHEN reason IS NULL AND bm > 0 THEN 1 - m / bm END, 6) AS saving FROM j""")
def variant_savings(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("variant")).agg(F.sum("o_totalprice").alias("m"), F.bool_and(F.col("o_orderstatus") != "P").alias("success"))
    return E.savings(runs, "1-URGENT", "m").withColumn("saving", F.round("saving", 6))


@query("evaluation_summary", """SELECT count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, 0::BIGINT AS abstained,
  round(avg(CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 2 END), 6) AS mean_recall, round(avg(o_custkey % 3), 6) AS mean_precision FROM orders""")
def evaluation_summary(spark, sf_dir):
    o = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.when(o == "F", "completed").when(o == "O", "failed").otherwise("other").alias("outcome"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 2).alias("recall"), (F.col("o_custkey") % 3).alias("precision"))
    return E.summary(rows).withColumns({"mean_recall": F.round("mean_recall", 6), "mean_precision": F.round("mean_precision", 6)})


@query("coverage_status", """WITH c AS (SELECT o_custkey AS scope, bool_or(o_orderstatus NOT IN ('F', 'O')) AS bad FROM orders GROUP BY 1), g AS (SELECT DISTINCT c_custkey AS scope FROM customer WHERE c_acctbal < 0)
  SELECT coalesce(c.scope, g.scope) AS scope, coalesce(bad, false) OR g.scope IS NOT NULL AS partial FROM c FULL JOIN g ON c.scope = g.scope""")
def coverage_status(spark, sf_dir):
    cov = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus") == "F", "produced").when(F.col("o_orderstatus") == "O", "not_applicable").otherwise("limited").alias("state"))
    gaps = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("scope"))
    return E.coverage_status(cov, gaps, gaps.limit(0))


@query("locator_overlap_match", """WITH x AS (SELECT l_orderkey AS case_id, l_linenumber AS id, l_partkey % 50 AS path, greatest(l_suppkey % 20, 1) AS s, greatest(l_suppkey % 20 + 5, greatest(l_suppkey % 20, 1)) AS e FROM lineitem WHERE l_returnflag = 'R'),
  a AS (SELECT l_orderkey AS case_id, l_linenumber AS id, l_partkey % 50 AS path, greatest(l_suppkey % 30, 1) AS s, greatest(l_suppkey % 30 + 3, greatest(l_suppkey % 30, 1)) AS e FROM lineitem WHERE l_returnflag <> 'R')
  SELECT case_id, x.id AS expected_id, a.id AS actual_id FROM x JOIN a USING (case_id, path) WHERE x.s <= a.e AND a.s <= x.e""")
def locator_overlap_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")

    def side(rows, name, mod, length):
        return rows.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias(name), (F.col("l_partkey") % 50).alias("path"), (F.col("l_suppkey") % mod).alias("start_line"), (F.col("l_suppkey") % mod + length).alias("end_line"))

    out = E.overlapping(side(li.filter("l_returnflag = 'R'"), "expected_id", 20, 5), side(li.filter("l_returnflag <> 'R'"), "evidence_id", 30, 3))
    return out.select("case_id", "expected_id", "actual_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from quarrylight.streaming.jobs import event_windows as windows

    return windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- sources to facts ----------------------------------------------------------------------------


@query("markup_extract")
def markup_extract(spark, sf_dir):
    """References, includes and metadata in the pages' markup."""
    return X.html_observations(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as small source files: a class per part with its calls."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("Part"), F.col("p_partkey"))
    java = F.format_string("package shop.%s;\nimport shop.Base;\npublic class %s extends Base {\n  // class Hidden {}\n  public int size() { return Stock.count(%d); }\n}\n", F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), name, F.col("p_size"))
    return p.select(F.concat(F.lit("src/"), name, F.lit(".java")).alias("path"), java.alias("text"), F.lower(F.regexp_replace("p_brand", "(?i)[^a-z0-9]", "")).alias("brand"), name.alias("name"))


@query("java_extract", """SELECT 'src/Part' || p_partkey || '.java' AS path, unnest([1, 2, 3, 3, 5, 5]) AS line, unnest(['package', 'import', 'type', 'extends', 'method', 'call']) AS type,
  unnest(['shop.' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 'shop.Base', 'Part' || p_partkey, 'Base', 'size', 'Stock.count']) AS name,
  unnest([NULL, NULL, 'class', 'Part' || p_partkey, NULL, NULL]) AS detail FROM part""")
def java_extract(spark, sf_dir):
    return X.java_observations(sources(spark, sf_dir))


@query("python_extract", """SELECT 'p' || p_partkey || '.py' AS path, unnest([1, 2, 3, 4]) AS line, unnest(['import', 'symbol', 'symbol', 'framework_call']) AS type,
  unnest(['a.b', 'C' || p_partkey, 'C' || p_partkey || '.m', p_brand]) AS name, unnest(['from', 'class', 'function', 'get_doc']) AS detail FROM part""")
def python_extract(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.format_string("from a import b\nclass C%d:\n  def m(self):\n    return frappe.get_doc('%s')  # import x\n", "p_partkey", "p_brand")
    return X.python_observations(p.select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".py")).alias("path"), text.alias("text")))


@query("xml_extract", """SELECT 's' || s_suppkey || '.xml' AS path, unnest([1, 2, 3]) AS line, unnest(['type', 'endpoint', 'gap']) AS type,
  unnest(['P' || s_suppkey, 'http://h/' || s_suppkey, 'dynamic_expression']) AS name, unnest(['proxy', 'address', 'property.value']) AS detail FROM supplier""")
def xml_extract(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.format_string('<proxy name="P%d">\n<address uri="http://u:p@h/%d?token=1"/>\n<property value="${x}"/></proxy>', "s_suppkey", "s_suppkey")
    return X.xml_observations(s.select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".xml")).alias("path"), text.alias("text")))


@query("java_facts", """SELECT predicate, count(*) AS facts FROM (
  SELECT unnest(['artifact', 'membership', 'symbol', 'definition', 'symbol_m', 'definition', 'reference', 'dependency', 'dependency', 'call']) AS predicate, p_partkey FROM part) WHERE predicate <> 'symbol_m' GROUP BY 1
  UNION ALL SELECT 'named_element', count(DISTINCT p_brand) FROM part""")
def java_facts(spark, sf_dir):
    from quarrylight.operators.normalize import normalize

    facts = normalize(X.java_observations(sources(spark, sf_dir)), "java", "s")
    # of the methods' symbols, which all files share, there is one fact
    return facts.filter("not (predicate = 'symbol' and subject_id = 'size')").groupBy("predicate").agg(F.count("*").alias("facts"))


@query("generic_extract", "SELECT CAST(doc_id AS VARCHAR) AS path, len(string_split(text, chr(10))) AS n FROM documents")
def generic_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    out = X.generic_observations(d).join(d.select("path", F.size(F.split("text", "\n", -1)).cast("long").alias("n")), "path")
    return out.select("path", "n")


@query("job_state_machine", """WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS job_id, n, CASE WHEN n >= 3 THEN 2 ELSE n - 1 END AS stage FROM e""")
def job_state_machine(spark, sf_dir):
    """Each user's events as a job: the first claims it, later ones advance it to
    the third stage at most."""
    from pyspark.sql import Window

    from quarrylight.streaming.jobs import job_states

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(w).cast("long"))
    ev = e.select(F.col("user_id").cast("string").alias("job_id"), "seq", F.when(F.col("seq") == 1, "claim").otherwise("advance").alias("event"), F.col("seq").alias("at"), F.lit(1_000_000).cast("long").alias("lease"), F.least(F.col("seq") - 1, F.lit(2)).cast("int").alias("stage"), F.col("seq").alias("processed"))
    return job_states(ev).groupBy("job_id").agg(F.count_if("accepted").alias("n"), F.max("stage").cast("long").alias("stage"))


# --- data sources -----------------------------------------------------------------------------------


@query("bundle_round_trip", """SELECT c_mktsegment AS artifact_type, o_orderpriority AS contribution_type, count(*) AS n, sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS size, count(DISTINCT c_custkey) AS artifacts
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def bundle_round_trip(spark, sf_dir):
    """Customers as artifacts and orders as their contributions, written as a bundle and read back."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    artifacts = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("s").alias("source_id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("type"), F.sha2("c_name", 256).alias("hash"), F.floor(F.abs("c_acctbal")).alias("size"))
    contributions = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("observed_at"))
    path = f"{shared_dir(spark)}/engine/bundle-{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(D.local(path)), exist_ok=True)
    D.publish_bundle({"artifacts": artifacts, "contributions": contributions}, path, {"organization": {"id": "o"}})
    got = D.open_bundle(spark, path)
    both = got["contributions"].select(F.col("artifact_id").alias("a"), F.col("type").alias("contribution_type")).join(got["artifacts"], F.col("a") == F.col("id"))
    return both.groupBy(F.col("type").alias("artifact_type"), "contribution_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("id").alias("artifacts"))


@query("directory_scan", """SELECT coalesce(source, '') AS folder, sum(strlen(coalesce(text, '')) + 1) AS size, count(*) = 0 AS bad FROM documents GROUP BY 1""")
def directory_scan(spark, sf_dir):
    """Documents as files in a folder for each source, scanned as a source tree."""
    path = f"{shared_dir(spark)}/engine/tree-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.coalesce("source", F.lit(""))).alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    rows.write.partitionBy("folder").text(path)
    found = D.scan_tree(spark, path, exclude=("**/.*.crc", "**/_SUCCESS"))
    files = found.filter("kind <> 'exclusion'").withColumn("folder", F.regexp_extract("path", "^folder=s([^/]*)/", 1))
    return files.groupBy("folder").agg(F.sum("size").alias("size"), F.bool_or(F.col("kind") != "artifact").alias("bad"))


def supplied_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each part and supplier of a line status, with its orders as
    evidence and the return flags as qualifiers."""
    key = [F.col("l_linestatus").alias("scope"), "l_partkey", "l_suppkey"]
    li = table(spark, sf_dir, "lineitem").select(*key, "l_orderkey", "l_returnflag").repartition("scope", "l_partkey", "l_suppkey")  # rows are smaller than sets
    li = li.groupBy("scope", "l_partkey", "l_suppkey").agg(
        F.array_sort(F.collect_set("l_orderkey"), lambda a, b: (b - a).cast("int")).alias("orders"), F.array_sort(F.collect_set("l_returnflag")).alias("flags")
    )
    return li.select(
        "scope", F.concat_ws("-", F.lit("f"), "l_partkey", "l_suppkey").alias("fact_id"), F.lit("supplied_by").alias("predicate"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"),
        F.transform("flags", lambda f: F.struct(F.lit("flag").alias("name"), f.alias("value"))).alias("qualifiers"), F.transform("orders", lambda o: F.struct(o.cast("string").alias("id"))).alias("evidence"),
        F.when(F.col("l_partkey") % 2 == 0, F.array(F.concat_ws("-", F.lit("f"), F.col("l_partkey") - 1, "l_suppkey"))).alias("inputs"),
    )


@query("factual_round_trip", """WITH f AS (SELECT l_linestatus AS scope, 'f-' || l_partkey || '-' || l_suppkey AS fact_id, l_partkey, array_to_string(list_sort(list(DISTINCT l_orderkey), 'DESC'), ',') AS evidence,
    string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, l_suppkey FROM lineitem GROUP BY l_linestatus, l_partkey, l_suppkey)
  SELECT scope, fact_id, l_partkey AS subject, flags, evidence, CASE WHEN l_partkey % 2 = 0 THEN 'f-' || (l_partkey - 1) || '-' || l_suppkey ELSE '' END AS inputs, 0 AS again, true AS refused FROM f""")
def factual_round_trip(spark, sf_dir):
    """Facts written in two parts, then all again, then with one changed; and read back."""
    store = f"{shared_dir(spark)}/engine/factual-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        facts = durable(supplied_facts(spark, sf_dir), "supplied", T.SMALL)
    T.persist_facts(facts.filter("subject % 3 = 0"), store, fixed=True)
    T.persist_facts(facts, store, fixed=True)
    again = T.persist_facts(facts, store, fixed=True)
    try:
        T.persist_facts(facts.withColumn("object", F.when(F.col("subject") == 1, -1).otherwise(F.col("object"))), store, fixed=True)
        refused = False
    except ValueError:
        refused = True
    discard(facts)
    got = T.read_facts(spark, store)
    flags, cited = F.array_join(F.transform("qualifiers", lambda q: q["value"]), ","), F.array_join(F.transform("evidence", lambda e: e["id"]), ",")
    return got.select("scope", "fact_id", "subject", flags.alias("flags"), cited.alias("evidence"), F.array_join("inputs", ",").alias("inputs"), F.lit(again).cast("int").alias("again"), F.lit(refused).alias("refused"))


# --- context policy ----------------------------------------------------------------------------------

_CONTEXT_SQL = f"""RECURSIVE {_INSPECT_SQL},
a AS (SELECT doc_id, doc_id % 4 AS query_id, 'd' || doc_id AS item_id, text, CASE doc_id % 10 WHEN 0 THEN 'fact' WHEN 1 THEN 'entity' ELSE 'evidence' END AS item_kind, kind,
  CASE WHEN {{authorization}} THEN NULL WHEN doc_id % 13 = 5 THEN 'deny' WHEN doc_id % 13 = 6 THEN 'redact' END AS auth, doc_id % 17 = 3 AS marked FROM k),
r AS (SELECT *, CASE WHEN auth = 'deny' THEN 'authorization_deny' WHEN item_kind <> 'evidence' AND auth = 'redact' THEN 'authorization_redact' WHEN item_kind <> 'evidence' AND kind <> 'safe_text' THEN 'inspection'
    WHEN item_kind = 'evidence' AND kind = 'binary' THEN 'invalid' WHEN item_kind = 'evidence' AND kind <> 'safe_text' THEN 'transfer_policy' END AS own,
  item_kind = 'evidence' AND coalesce(text, '') <> '' AND (coalesce(auth, '') = 'redact' OR marked) AS hidden FROM a),
e AS (SELECT doc_id, doc_id - 4 AS leans FROM r WHERE doc_id % 5 <> 0 AND doc_id >= 4 UNION ALL SELECT doc_id, (doc_id // 8) * 4 + doc_id % 4 FROM r WHERE doc_id % 6 = 0),
gone AS (SELECT doc_id FROM r WHERE own IS NOT NULL UNION SELECT e.doc_id FROM e JOIN gone g ON e.leans = g.doc_id WHERE e.leans <> e.doc_id),
s AS (SELECT query_id, doc_id, item_id, item_kind, CASE WHEN own IS NOT NULL THEN own WHEN doc_id IN (SELECT doc_id FROM gone) THEN 'support' END AS reason,
  CASE WHEN hidden THEN 'evidence-' || sha256(length(item_id) || ':' || item_id || '10:[redacted]') ELSE item_id END AS shown, CASE WHEN hidden THEN 10 ELSE coalesce(strlen(text), 0) END AS size, hidden FROM r)"""
_POLICY_SQL, _AUTHORIZED_SQL = _CONTEXT_SQL.format(authorization="FALSE"), _CONTEXT_SQL.format(authorization="TRUE")


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of four contexts; each may need the one four before it and
    cite the one in the middle, and some are marked, denied or to be redacted."""
    i, n = F.col("doc_id"), lambda c: F.concat(F.lit("d"), c)
    supports = F.when((i % 5 != 0) & (i >= 4), F.array(n(i - 4)))
    cited = F.when(i % 6 == 0, F.array(n(F.floor(i / 8) * 4 + i % 4), F.lit("elsewhere")))
    return table(spark, sf_dir, "documents").select(
        (i % 4).alias("query_id"), n(i).alias("item_id"), F.when(i % 10 == 0, "fact").when(i % 10 == 1, "entity").otherwise("evidence").alias("kind"), F.col("text").alias("content"),
        F.when(i % 13 == 5, "deny").when(i % 13 == 6, "redact").otherwise("allow").alias("authorization"), F.lit("allow").alias("persist"), F.when(i % 17 == 3, "redact").alias("transfer"),
        supports.alias("supports"), cited.alias("provenance"), (F.lit(1.0) / (i + 1)).alias("relevance"), (i % 100).alias("rank"), F.array(F.lit("evidence")).alias("aspects"),
    )


def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each document to the one four after it, by way of both, told by the one eight after it."""
    i, n = F.col("doc_id"), lambda c: F.concat(F.lit("d"), c)
    return table(spark, sf_dir, "documents").select(
        (i % 4).alias("query_id"), F.concat(F.lit("r"), i).alias("relation_id"), n(i).alias("from_id"), n(i + 4).alias("to_id"), F.array(n(i), n(i + 4)).alias("path"),
        F.when(i % 3 == 0, F.array(n(i + 8))).alias("supports"), F.when(i % 7 == 0, F.array(n(i + 12), F.lit("elsewhere"))).alias("provenance"), F.lit(0.5).alias("score"), (i % 100).alias("rank"),
    )


_LINKS_SQL = """l AS (SELECT d.query_id, 'r' || d.doc_id AS relation_id, d.doc_id % 100 AS rank, f.shown AS from_id, t.shown AS to_id, u.shown AS support, d.doc_id % 3 = 0 AS told,
  CASE WHEN f.reason IS NOT NULL OR t.doc_id IS NULL OR t.reason IS NOT NULL THEN 'endpoint' WHEN d.doc_id % 3 = 0 AND (u.doc_id IS NULL OR u.reason IS NOT NULL) THEN 'support'
    WHEN d.doc_id % 7 = 0 AND c.reason IS NOT NULL THEN 'support' END AS reason
  FROM s d JOIN s f ON f.doc_id = d.doc_id LEFT JOIN s t ON t.doc_id = d.doc_id + 4 LEFT JOIN s u ON u.doc_id = d.doc_id + 8 LEFT JOIN s c ON c.doc_id = d.doc_id + 12)"""


@query("policy_filter", f"WITH {_POLICY_SQL} SELECT query_id, item_id, item_kind AS kind, reason, CASE WHEN reason IS NULL THEN shown END AS output_id, hidden AND reason IS NULL AS redacted FROM s")
def policy_filter(spark, sf_dir):
    return O.apply_policy(context_items(spark, sf_dir), texts=False)[0].drop("content")


@query("policy_relations", f"WITH {_POLICY_SQL}, {_LINKS_SQL} SELECT query_id, relation_id, reason, CASE WHEN reason IS NULL THEN from_id END AS from_id, CASE WHEN reason IS NULL THEN to_id END AS to_id, CASE WHEN reason IS NULL AND told THEN support WHEN reason IS NULL THEN '' END AS supports FROM l")
def policy_relations(spark, sf_dir):
    links = O.apply_policy(context_items(spark, sf_dir), context_relations(spark, sf_dir), texts=False)[1]
    return links.select("query_id", "relation_id", "reason", "from_id", "to_id", F.array_join("supports", ",").alias("supports"))


@query("authorized_projection", f"""WITH {_AUTHORIZED_SQL}, {_LINKS_SQL}
  SELECT s.query_id, s.item_kind AS kind, s.shown AS id, s.doc_id % 100 AS rank, coalesce(p.shown, '') AS supports, CAST(ceil(s.size / 4.0) AS BIGINT) AS tokens FROM s LEFT JOIN s p ON p.doc_id = s.doc_id - 4 AND s.doc_id % 5 <> 0 WHERE s.reason IS NULL
  UNION ALL SELECT query_id, 'relation', relation_id, rank, CASE WHEN told THEN support ELSE '' END,
    CAST(ceil((2 * (strlen(from_id) + strlen(to_id)) + 4 + CASE WHEN told THEN strlen(support) ELSE 0 END) / 4.0) AS BIGINT) FROM l WHERE reason IS NULL""")
def authorized_projection(spark, sf_dir):
    """Candidates and relations under the policy, as one table."""
    items, links = O.authorized_projection(context_items(spark, sf_dir), context_relations(spark, sf_dir))
    supports = F.array_join("supports", ",").alias("supports")
    shown = items.select("query_id", "kind", F.col("item_id").alias("id"), "rank", supports, "tokens")
    return shown.unionByName(links.select("query_id", F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), "rank", supports, "tokens"))


# --- evidence matching -------------------------------------------------------------------------------

_MATCH_SQL = """u AS (SELECT l_suppkey AS b, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS p, min(l_returnflag) AS f, min(l_linestatus) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
units AS (SELECT b, id, 'p' || (p % 7) || '/m' || f || '.java' AS path, lower(f) AS member, 'x' || lower(s) AS content, CASE WHEN p % 97 > 0 THEN p % 97 END AS a, p % 97 + CAST(q AS BIGINT) AS z FROM u),
x AS (SELECT b, id, CASE id % 5 WHEN 0 THEN 'p' || (p % 7) || '/m' || f || '\\.java' WHEN 1 THEN 'p[^/]*/m' || f || '\\.java' WHEN 2 THEN 'p[0-' || (p % 7) || ']/m[^/]\\.java' END AS rx,
  CASE WHEN id % 5 = 0 THEN 110 WHEN id % 5 < 3 THEN 60 ELSE 10 END AS worth, CASE WHEN id % 5 = 4 THEN lower(f) END AS member, id % 2 = 0 AND p % 60 + 5 > 0 AS lined, greatest(p % 60, 1) AS a, p % 60 + 5 AS z FROM u WHERE q >= 49),
most AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM x GROUP BY b)),
m AS (SELECT x.b AS case_id, x.id AS expected_id, units.id AS evidence_id, worth + CASE WHEN x.member IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN lined THEN 10 ELSE 0 END AS score
  FROM x JOIN units USING (b) WHERE (rx IS NULL OR regexp_full_match(path, rx)) AND (x.member IS NULL OR contains(units.member, x.member) OR contains(content, x.member))
  AND (NOT lined OR units.a IS NULL OR (x.a <= units.z AND units.a <= x.z))),
t AS (SELECT *, row_number() OVER (PARTITION BY case_id, expected_id ORDER BY score DESC, evidence_id) AS place FROM m)"""


def expectations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, units): a supplier's line items as its evidence, the large ones as what is expected."""
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("bundle_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.max("l_quantity").alias("q")
    )
    part, flag, start = (F.col("p") % 7).cast("string"), F.col("f"), F.col("p") % 97
    units = u.select("bundle_id", F.col("id").alias("evidence_id"), F.concat(F.lit("p"), part, F.lit("/m"), flag, F.lit(".java")).alias("path"), F.lower(flag).alias("member"), F.lit(None).cast("string").alias("method"), F.concat(F.lit("x"), F.lower("s")).alias("content"), F.when(start > 0, start).alias("start_line"), (start + F.col("q").cast("long")).alias("end_line"))
    way, lined = F.col("id") % 5, F.col("id") % 2 == 0
    glob = F.when(way == 0, F.concat(F.lit("p"), part, F.lit("/m"), flag, F.lit(".java"))).when(way == 1, F.concat(F.lit("p*\\m"), flag, F.lit(".java"))).when(way == 2, F.concat(F.lit("p[0-"), part, F.lit("]/m?.java")))
    x = u.filter("q >= 49").select("bundle_id", F.col("bundle_id").alias("case_id"), F.col("id").alias("expected_id"), glob.alias("path"), F.when(way == 4, F.concat(F.lit(" "), flag)).alias("member"), F.lit(None).cast("string").alias("attribute"), F.when(lined, F.col("p") % 60).alias("start_line"), F.when(lined, F.col("p") % 60 + 5).alias("end_line"))
    return x, units


@query("evidence_match_scores", f"WITH {_MATCH_SQL} SELECT case_id, expected_id, evidence_id, score, place FROM t, most WHERE place <= n")
def evidence_match_scores(spark, sf_dir):
    return M.scored_matches(*expectations(spark, sf_dir))


@query("evidence_match_greedy", f"""WITH RECURSIVE {_MATCH_SQL},
  o AS (SELECT case_id, expected_id, list(evidence_id ORDER BY place) AS ids, row_number() OVER (PARTITION BY case_id ORDER BY expected_id) AS i FROM t, most WHERE place <= n GROUP BY 1, 2),
  g AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS expected_id, CAST(NULL AS BIGINT) AS evidence_id, FALSE AS reused FROM o
    UNION ALL SELECT case_id, i, list_append(used, coalesce(pick, ids[1])), expected_id, coalesce(pick, ids[1]), pick IS NULL FROM (
      SELECT g.case_id, o.i, g.used, o.expected_id, o.ids, list_filter(o.ids, lambda e: NOT list_contains(g.used, e))[1] AS pick FROM g JOIN o ON o.case_id = g.case_id AND o.i = g.i + 1))
  SELECT case_id, expected_id, evidence_id, reused FROM g WHERE i > 0""")
def evidence_match_greedy(spark, sf_dir):
    return E.greedy_match(evidence_match_scores(spark, sf_dir))


# --- candidate projection ------------------------------------------------------------------------------

_CANDIDATES_SQL = """u AS (SELECT o_custkey AS query_id, 'u' || o_orderkey AS unit_id, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey END AS external_id, o_totalprice / 500000 AS score,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey % 4 = 0 AS related, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
fe AS (SELECT DISTINCT o_custkey AS c, l_suppkey % 10 AS s, o_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hit AS (SELECT fe.c, fe.s, count(*) AS n, count(u.k) AS found, string_agg(u.unit_id, ',' ORDER BY u.unit_id) AS evidence, min(u.rank) AS rank, max(u.score) AS score, bool_or(u.related) AS related
  FROM fe LEFT JOIN u ON u.query_id = fe.c AND u.k = fe.k GROUP BY 1, 2),
f AS (SELECT *, 'says ' || c || '-' || s AS statement, CASE WHEN s % 2 = 0 THEN 'dependency' ELSE 'call' END AS predicate, CASE WHEN s = 3 THEN 'derived' ELSE 'observed' END AS origin FROM hit WHERE n = found),
g AS (SELECT *, 'fact-' || sha256(strlen(statement) || ':' || statement || strlen(evidence) || ':' || evidence) AS id FROM f),
p AS (SELECT c, 'c' || c AS id, 'artifact' AS part, rank, score, related, s, origin FROM g UNION ALL SELECT c, 's' || s, 'symbol', rank, score, related, s, origin FROM g WHERE s <> 7),
e AS (SELECT c, id, min(part) AS part, min(rank) AS rank, max(score) AS score, bool_or(related) AS related, arg_min(origin, rank * 10 + s) AS origin FROM p GROUP BY 1, 2),
all_of AS (SELECT query_id, unit_id AS item_id, 'evidence' AS kind, 'observed' AS origin, score, rank, 'evidence,source' AS aspects, related FROM u
  UNION ALL SELECT c, id, 'fact', origin, score, rank, CASE WHEN predicate = 'dependency' THEN 'dependency,evidence' ELSE 'fact,evidence' END, related FROM g
  UNION ALL SELECT c, id, 'entity', origin, score, rank, part || ',locator', related FROM e)"""


def customer_retrieval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(retrieved, facts): each customer's settled orders as what it retrieved, dearest first, and
    what its line items say of groups of suppliers, told from all of its orders."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    k, name = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c)
    got = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("query_id"), name("e", k).alias("evidence_id"), name("u", k).alias("unit_id"), F.when(k % 3 == 0, name("x", k)).alias("external_id"), (F.col("o_totalprice") / 500000).alias("score"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), (k % 4 == 0).alias("related"),
    )
    ref = lambda k: F.when(k % 6 == 0, name("u", k)).when(k % 3 == 0, name("x", k)).otherwise(name("u", k))
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == k).groupBy(F.col("o_custkey").alias("c"), (F.col("l_suppkey") % 10).alias("s")).agg(F.transform(F.collect_set("o_orderkey"), ref).alias("evidence"))
    of = lambda s: F.concat_ws("-", F.concat(F.lit("f"), F.col("c")), s)
    facts = li.select(
        of(F.col("s")).alias("fact_id"), F.concat_ws("-", F.concat(F.lit("says "), F.col("c")), "s").alias("statement"), F.when(F.col("s") % 2 == 0, "dependency").otherwise("call").alias("predicate"), name("c", F.col("c")).alias("subject_id"), F.lit("artifact").alias("subject_kind"),
        F.when(F.col("s") != 7, name("s", F.col("s"))).alias("object_id"), F.when(F.col("s") != 7, "symbol").alias("object_kind"), "evidence", F.when(F.col("s") == 3, F.array(of(F.lit(4)), of(F.lit(5)))).alias("inputs"),
    )
    return got, facts


@query("candidate_projection_all", f"""WITH {_CANDIDATES_SQL} SELECT query_id, item_id, kind, origin, round(least(1, greatest(0.01, score)), 9) AS relevance, rank, aspects || CASE WHEN related THEN ',relation' ELSE '' END AS aspects,
  row_number() OVER (PARTITION BY query_id ORDER BY rank, kind, item_id) AS place FROM all_of""")
def candidate_projection_all(spark, sf_dir):
    out = K.project(*customer_retrieval(spark, sf_dir)).candidates
    return out.select("query_id", "item_id", "kind", "origin", F.round("relevance", 9).alias("relevance"), "rank", F.array_join("aspects", ",").alias("aspects"), "place")


@query("candidate_relations", f"""WITH {_CANDIDATES_SQL} SELECT c AS query_id, predicate, origin, 'c' || c AS from_id, 's' || s AS to_id, id || ',' || evidence AS supports, round(least(1, greatest(0.01, score)), 9) AS score, rank,
    EXISTS (SELECT 1 FROM hit h WHERE h.c = g.c AND h.found > 0 AND h.found < h.n) OR EXISTS (SELECT 1 FROM g d WHERE d.c = g.c AND d.s = 3 AND (SELECT count(*) FROM g i WHERE i.c = g.c AND i.s IN (4, 5)) < 2) AS incomplete FROM g WHERE s <> 7""")
def candidate_relations(spark, sf_dir):
    """Relation candidates, with whether something of their query was left out."""
    out = K.project(*customer_retrieval(spark, sf_dir))
    told = out.relations.join(out.incomplete.withColumn("lost", F.lit(True)), "query_id", "left")
    return told.select("query_id", "predicate", "origin", "from_id", "to_id", F.array_join("supports", ",").alias("supports"), F.round("score", 9).alias("score"), "rank", F.coalesce("lost", F.lit(False)).alias("incomplete"))


# --- quality of variants -------------------------------------------------------------------------------

_QUALITY_SQL = """cs AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
rc AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_tax >= 0.04), ee AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 20 AS i FROM lineitem),
ac AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS c, l_partkey % 20 AS i FROM lineitem), eg AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS i FROM lineitem WHERE l_quantity > 25),
rs AS (SELECT l_orderkey AS k, l_linestatus AS v, sum(l_extendedprice) AS actual_cost, count(*) AS files_read, CASE WHEN l_orderkey % 4 > 0 THEN max(l_quantity) END AS duration FROM lineitem GROUP BY 1, 2),
cl AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS v, l_linenumber AS i FROM lineitem WHERE l_tax >= 0.03), ev AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS v, l_suppkey % 20 AS i FROM lineitem),
ct AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS v, l_linenumber AS c, l_suppkey % 20 AS i FROM lineitem WHERE l_discount > 0.02), gp AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS v, l_returnflag AS i FROM lineitem),
n AS (SELECT k, v, actual_cost, files_read, duration, k % 7 > 0 AS done, k % 5 = 0 AS abstained, k % 3 = 0 AS abstain,
  (SELECT count(*) FROM rc WHERE rc.k = rs.k) AS ref, (SELECT count(*) FROM cl WHERE cl.k = rs.k AND cl.v = rs.v) AS made, (SELECT count(*) FROM cl JOIN rc USING (k, i) WHERE cl.k = rs.k AND cl.v = rs.v) AS right_,
  (SELECT count(*) FROM ee WHERE ee.k = rs.k) AS expected, (SELECT count(*) FROM ev WHERE ev.k = rs.k AND ev.v = rs.v) AS retrieved, (SELECT count(*) FROM ev JOIN ee USING (k, i) WHERE ev.k = rs.k AND ev.v = rs.v) AS relevant,
  (SELECT count(*) FROM ct WHERE ct.k = rs.k AND ct.v = rs.v) AS cites, (SELECT count(*) FROM ct JOIN ac USING (k, c, i) JOIN ev USING (k, v, i) JOIN cl ON cl.k = ct.k AND cl.v = ct.v AND cl.i = ct.c WHERE ct.k = rs.k AND ct.v = rs.v) AS valid,
  (SELECT count(*) FROM eg WHERE eg.k = rs.k) AS gaps, (SELECT count(*) FROM gp JOIN eg USING (k, i) WHERE gp.k = rs.k AND gp.v = rs.v) AS seen FROM rs),
q AS (SELECT k AS case_id, v AS variant, actual_cost, files_read, duration, ref = made AND made = right_ AS correct, done AND (NOT abstained OR abstain) AS completed, done AND abstained = abstain AS abstention_appropriate,
  relevant / nullif(expected, 0) AS evidence_recall, relevant / nullif(retrieved, 0) AS evidence_precision, valid / nullif(cites, 0) AS citation_rate, seen / nullif(gaps, 0) AS gap_recall FROM n)"""


def variant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, their lines of each status as a variant's answer, with their quality."""
    li = table(spark, sf_dir, "lineitem").withColumns({"part": F.col("l_partkey") % 20, "supp": F.col("l_suppkey") % 20})
    some = lambda c, when=None: F.collect_set(F.col(c) if when is None else F.when(F.expr(when), F.col(c)))
    cases = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        some("l_linenumber", "l_tax >= 0.04").alias("reference_claims"), some("part").alias("expected_evidence"), some("l_returnflag", "l_quantity > 25").alias("expected_gaps"),
        F.collect_set(F.struct(F.col("l_linenumber").alias("claim_id"), F.array("part").alias("evidence_ids"))).alias("acceptable"),
    ).withColumn("abstention_expected", F.col("case_id") % 3 == 0)
    k = F.col("case_id")
    results = li.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("variant")).agg(
        some("l_linenumber", "l_tax >= 0.03").alias("claims"), some("supp").alias("evidence"), some("l_returnflag").alias("gaps"), F.collect_set(F.when(F.col("l_discount") > 0.02, F.struct(F.col("l_linenumber").alias("claim_id"), F.col("supp").alias("evidence_id")))).alias("citations"),
        F.sum("l_extendedprice").alias("actual_cost"), F.count("*").alias("files_read"), F.max("l_quantity").alias("most"),
    ).withColumns({"duration": F.when(k % 4 > 0, F.col("most")), "status": F.when(k % 7 > 0, "completed").otherwise("limited"), "conclusion": F.when(k % 5 == 0, "abstained").otherwise("passed")})
    return Q.derive_quality(cases, results)


_QUALITY = ("evidence_recall", "evidence_precision", "citation_rate", "gap_recall")


@query("variant_quality", f"WITH {_QUALITY_SQL} SELECT case_id, variant, correct, completed, abstention_appropriate, {', '.join(f'round({c}, 9) AS {c}' for c in _QUALITY)} FROM q")
def variant_quality(spark, sf_dir):
    return variant_runs(spark, sf_dir).select("case_id", "variant", "correct", "completed", "abstention_appropriate", *[F.round(c, 9).alias(c) for c in _QUALITY])


_REPORTED = ("actual_cost", "files_read", "duration", "correct", "completed", *_QUALITY, "abstention_appropriate")


@query("metric_report", f"""WITH {_QUALITY_SQL}, m AS ({' UNION ALL '.join(f"SELECT variant, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM q" for c in _REPORTED)})
  SELECT variant, metric, count(value) AS count, round(min(value), 4) AS min, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(max(value), 4) AS max, round(stddev_pop(value), 4) AS stddev FROM m WHERE value IS NOT NULL GROUP BY 1, 2""")
def metric_report(spark, sf_dir):
    out = Q.metric_report(variant_runs(spark, sf_dir), ["variant"])
    return out.select("variant", "metric", "count", *[F.round(c, 4).alias(c) for c in ("min", "mean", "median", "max", "stddev")])


# --- update plans ---------------------------------------------------------------------------------------

_UPDATE_SQL = """a AS (SELECT o_orderkey AS k, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus <> 'P' AS kept, CASE WHEN c_custkey % 9 = 0 THEN 'artifact_removed' WHEN c_acctbal < 0 THEN 'artifact_hash_changed' END AS st FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("update_plan_facts", f"""WITH {_UPDATE_SQL} SELECT 'o' || k AS fact_id, CASE WHEN NOT kept THEN 'removed' WHEN st IS NULL THEN 'reused' ELSE 'reprocess' END AS action, CASE WHEN kept THEN 'n' || k END AS current_id, coalesce(st, CASE WHEN kept THEN '' ELSE 'observed_changed_or_missing' END) AS reasons FROM a
  UNION ALL SELECT 'd' || k, CASE WHEN urgent OR NOT kept OR st IS NOT NULL THEN 'reevaluate' ELSE 'reusable' END, NULL, concat_ws(',', CASE WHEN urgent THEN 'rule_implementation_or_configuration_changed' END, CASE WHEN NOT kept OR st IS NOT NULL THEN 'upstream_lineage' END) FROM a""")
def update_plan_facts(spark, sf_dir):
    """Customers as artifacts, their orders as facts, and a fact derived from each, in two snapshots."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = durable(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "settled")
    n = lambda p, k: F.concat(F.lit(p), F.col(k))
    manifests = spark.range(1).select(F.lit("p/1").alias("producer"), F.lit("p").alias("family"), F.lit("1").alias("version"), F.lit("b").alias("base"), F.lit("s").alias("schemas"))

    def revision(p, artifacts, facts, urgent):
        observed = facts.select(n(p, "o_orderkey").alias("fact_id"), U.stable_key(F.col("o_orderkey")).alias("stable_key"), F.lit("p/1").alias("producer"), F.array(n("c", "o_custkey")).alias("paths"))
        derived = facts.select(n("d", "o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("rule"), F.array(n(p, "o_orderkey")).alias("inputs"))
        rules = o.select(F.col("o_orderpriority").alias("rule")).distinct().withColumn("digest", F.when(F.col("rule") == "1-URGENT", urgent).otherwise("1"))
        return U.Revision(artifacts, observed, derived, manifests, rules, "c")

    before = revision("o", c.select(n("c", "c_custkey").alias("path"), F.lit("1").alias("hash")), o, "1")
    after = revision("n", c.filter("c_custkey % 9 <> 0").select(n("c", "c_custkey").alias("path"), F.when(F.col("c_acctbal") < 0, "2").otherwise("1").alias("hash")), o.filter("o_orderstatus <> 'P'"), "2")
    plan = U.plan_update(before, after)
    out = plan.observed.select(F.col("previous_id").alias("fact_id"), "action", "current_id", F.array_join("reasons", ",").alias("reasons"))
    return out.unionByName(plan.derived.select("fact_id", "action", F.lit(None).cast("string").alias("current_id"), F.array_join("reasons", ",").alias("reasons")))
