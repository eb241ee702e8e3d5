"""Budgeted selection, packaging and the decision to abstain.

The greedy loops depend on order (skip and go on is no prefix cut), so they run
as one function per query over its candidates, of which retrieval keeps at most
10,000; many queries run in one job.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.text import content_id

MAX_CANDIDATES = 10_000


@dataclass(frozen=True)
class PackageLimits:
    # The default limits of a package.
    units: int = 32
    characters: int = 32 << 10
    bytes: int = 256 << 10
    tokens: int = 8 << 10
    characters_per_token: int = 4
    per_artifact: int = 8
    per_type: int = 16


def compose(candidates: DataFrame, limits: PackageLimits = PackageLimits()) -> DataFrame:
    """One audit row for each candidate: query_id, evidence_id, place, reason.

    ``candidates``: query_id, evidence_id, content_hash, content, artifact_id,
    kind, score, rank. In the order score (largest first), rank (0 last), id,
    artifact, kind. Id and hash count as seen even if a budget then refuses.
    """

    names = ("unit_limit", "character_limit", "byte_limit", "token_limit")
    most = np.array([limits.units, limits.characters, limits.bytes, limits.tokens])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_CANDIDATES:
            raise ValueError("too many candidates of one query")
        pdf = pdf.assign(_last=(pdf["rank"] == 0)).sort_values(["score", "_last", "rank", "evidence_id", "artifact_id", "kind"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        reasons = pd.Series("included", index=pdf.index)
        again = pdf["evidence_id"].duplicated()
        reasons[again] = "duplicate_evidence_id"
        same = pdf.loc[~again, "content_hash"].duplicated()
        reasons[same.index[same]] = "duplicate_content_hash"
        text = pdf["content"].fillna("")
        length = text.str.len().to_numpy(np.int64)
        cost = np.column_stack([np.ones(len(pdf), np.int64), length, text.map(lambda x: len(x.encode())).to_numpy(np.int64), -(-length // limits.characters_per_token)])
        # what each is refused for depends on what those before it took, and on nothing else
        taken = np.zeros(4, np.int64)
        held: Counter = Counter()
        for k in np.flatnonzero(reasons == "included"):
            artifact, kind = ("artifact", pdf["artifact_id"][k]), ("kind", pdf["kind"][k])
            over = [names[i] for i in np.flatnonzero(taken + cost[k] > most)]
            over += ["artifact_diversity_limit"] * (held[artifact] >= limits.per_artifact) + ["type_diversity_limit"] * (held[kind] >= limits.per_type)
            if over:
                reasons[k] = over[0]
            else:
                taken += cost[k]
                held.update((artifact, kind))
        return pd.DataFrame({"query_id": pdf["query_id"], "evidence_id": pdf["evidence_id"], "place": range(1, len(pdf) + 1), "reason": reasons})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, evidence_id {kinds['evidence_id']}, place long, reason string")


@dataclass(frozen=True)
class SelectionLimits:
    items: int = 20
    tokens: int = 2048
    characters: int = 1 << 20
    bytes: int = 1 << 20


@dataclass(frozen=True)
class Utility:
    relevance: float = 1.0
    aspects: float = 0.5
    kind: float = 0.25
    artifact: float = 0.25


def greedy_select(candidates: DataFrame, limits: SelectionLimits = SelectionLimits(), utility: Utility = Utility()) -> DataFrame:
    """Candidates picked one by one for the greatest gain per token.

    Gain = relevance + new aspects + a new kind + a new artifact, weighted and
    evaluated anew at every step; ties: gain, rank, id. ``candidates``: query_id,
    item_id, kind, artifact_id, relevance, rank, aspects, redundancy_key, tokens,
    characters, bytes. Returns query_id, item_id, included, step, reason, gain.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_CANDIDATES:
            raise ValueError("too many candidates of one query")
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        cost = pdf[["tokens", "characters", "bytes"]].to_numpy(np.int64)
        most = np.array([limits.tokens, limits.characters, limits.bytes])
        # what each item would bring: a column for every aspect, kind and artifact
        brings = {name: column for name in ("kind", "artifact_id") for column in [pd.get_dummies(pdf[name], dummy_na=True).to_numpy(bool)]}
        every = sorted({a for x in pdf["aspects"] for a in x}, key=str)
        brings["aspects"] = np.array([[a in set(x) for a in every] for x in pdf["aspects"]], bool).reshape(len(pdf), len(every))
        worth = {"aspects": utility.aspects, "kind": utility.kind, "artifact_id": utility.artifact}
        new = {name: np.ones(table.shape[1], bool) for name, table in brings.items()}
        key = pdf["redundancy_key"].to_numpy()
        relevance, rank, tokens = pdf["relevance"].to_numpy(float), pdf["rank"].to_numpy(), np.maximum(cost[:, 0], 1)
        step_of, told = np.zeros(len(pdf), int), np.zeros(len(pdf))
        dull = np.zeros(len(pdf), bool)
        while (step_of > 0).sum() < limits.items:
            picked = step_of > 0
            fits = (cost[picked].sum(axis=0) + cost <= most).all(axis=1) & ~picked & ~np.isin(key, key[picked])
            gain = utility.relevance * relevance + sum(worth[name] * (table & new[name]).sum(axis=1) for name, table in brings.items())
            told = np.where(fits, gain, told)
            dull = fits & (gain <= 0)
            able = np.flatnonzero(fits & (gain > 0))
            if not len(able):
                break
            best = able[np.lexsort((able, rank[able], -gain[able], -gain[able] / tokens[able]))[0]]
            step_of[best] = picked.sum() + 1
            for name, table in brings.items():
                new[name] &= ~table[best]
        included = step_of > 0
        reason = np.where(included, "included", np.where(np.isin(key, key[included]) | dull, "redundancy", "budget"))
        return pd.DataFrame({"query_id": pdf["query_id"], "item_id": pdf["item_id"], "included": included, "step": step_of, "reason": reason, "gain": told})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, included boolean, step int, reason string, gain double")


def support_closure(relations: DataFrame, support: DataFrame, selected: DataFrame, limits: SelectionLimits = SelectionLimits()) -> DataFrame:
    """Relations to add with all support they still need, each whole or not at all.

    ``relations``: query_id, relation_id, score, rank, needs (array of item ids),
    tokens; ``support``: query_id, item_id, tokens; ``selected``: query_id,
    item_id, tokens. Order: score (largest first), rank, id. Relations pass in
    order, one after the other; only what a query has taken is held.
    """
    there = support.groupBy("query_id", F.col("item_id").alias("need")).agg(F.max("tokens").cast("long").alias("cost"))
    held = selected.groupBy("query_id", F.col("item_id").alias("need")).agg(F.max("tokens").cast("long").alias("own"))
    sums = held.groupBy("query_id").agg(F.sum("own").alias("used"), F.count("*").alias("count"))
    each = ["query_id", "relation_id", "score", "rank", "tokens", "needs"]
    asked = relations.select(*each, F.explode_outer(F.array_distinct("needs")).alias("need")).join(there, ["query_id", "need"], "left").join(held, ["query_id", "need"], "left")
    # an item that is there costs 0 or more, -1 stands for one that is missing
    item = F.when(F.col("need").isNotNull() & F.col("own").isNull(), F.struct("need", F.coalesce("cost", F.lit(-1)).alias("cost")))
    rows = asked.groupBy(*each).agg(F.sort_array(F.collect_list(item)).alias("items")).join(sums, "query_id", "left")
    rows = rows.select("query_id", "relation_id", "score", "rank", F.col("tokens").cast("long").alias("tokens"), F.col("items.need").alias("names"), F.col("items.cost").alias("costs"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("count", F.lit(0)).alias("count"))
    rows = rows.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "rank", "relation_id")

    def run(batches):
        query, have, used, count = None, set(), 0, 0  # of one query at a time; have is bounded by the limit of items
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.query_id != query:
                    query, have, used, count = r.query_id, set(), int(r.used), int(r.count)
                need = [(n, int(c)) for n, c in zip(r.names, r.costs, strict=True) if n not in have]
                cost = int(r.tokens) + sum(max(c, 0) for _, c in need)
                if any(c < 0 for _, c in need):
                    reason = "support_missing"
                elif count + 1 + len(need) > limits.items or used + cost > limits.tokens:
                    reason = "budget"
                else:
                    reason = "included"
                    have |= {n for n, _ in need} | {r.relation_id}
                    used, count = used + cost, count + 1 + len(need)
                out.append((r.query_id, r.relation_id, reason, [n for n, _ in need] if reason == "included" else []))
            yield pd.DataFrame(out, columns=["query_id", "relation_id", "reason", "added"])

    kinds = dict(relations.dtypes)
    return rows.mapInPandas(run, f"query_id {kinds['query_id']}, relation_id {kinds['relation_id']}, reason string, added array<{dict(support.dtypes)['item_id']}>")


def policy_cascade(items: DataFrame, needs: DataFrame, denied: DataFrame) -> DataFrame:
    """Items that stay when the denied go, and with them, again and again, all
    that need one that went. ``needs``: item_id, needs_id."""
    from quarrylight.runtime import durable

    gone = durable(denied.select("item_id").distinct(), "denied")
    while True:
        more = needs.join(gone.select(F.col("item_id").alias("needs_id")), "needs_id", "left_semi").select("item_id").distinct().join(gone, "item_id", "left_anti")
        more = durable(more, "denied-more")
        if more.isEmpty():
            return items.join(gone, "item_id", "left_anti")
        gone = durable(gone.union(more), "denied")


def abstention(evidence_count: Column, local_only: Column, support_kind: Column, question_kind: Column, level: Column) -> Column:
    """Why to abstain, in a fixed order; null: answer."""
    return (
        F.when((evidence_count == 0) & (local_only > 0), "transfer_prohibited")
        .when(evidence_count == 0, "no_transferable_evidence")
        .when((support_kind != "") & (support_kind != question_kind), "kind_mismatch")
        .when((F.coalesce(support_kind, F.lit("")) == "") | (level != "sufficient"), "insufficient_support")
    )


def support_level(question_kind: Column, any_transferable: Column) -> Column:
    """Only inventory and possible flow can be told from evidence alone."""
    return F.when(question_kind.isin("inventory", "possible_flow") & any_transferable, "sufficient").otherwise("insufficient")


def uncited(claims: DataFrame, package: DataFrame) -> DataFrame:
    """Claims that cite nothing, or evidence that isn't in the query's package."""
    cited = claims.select("query_id", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = package.select("query_id", "evidence_id").distinct()
    return cited.join(known, ["query_id", "evidence_id"], "left_anti").select("query_id", "claim_id").distinct()


def package_id(package: DataFrame, configuration: str) -> DataFrame:
    """A digest over each query's evidence in order (``place``) and the configuration.

    Packages are bounded by their limits, so one row can hold a package's ids."""
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col("evidence_id").cast("string").alias("id"))))
    ids = package.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["id"]), ",").alias("ids"))
    return ids.select("query_id", content_id("package", F.col("query_id"), F.lit(configuration), F.col("ids")).alias("package_id"))


def spend(calls: DataFrame, limit: float, tokens: int | None = None, requests: int | None = None) -> DataFrame:
    """Whether each call fits an account's limits, in order of ``seq``.

    Needs account, seq, cost, and tokens where a limit of them is given. A call is
    admitted if cost, tokens and requests stay within their limits together; only
    admitted calls count, so a refused one never shuts out those after it. Adds
    total (the account's admitted cost so far) and admitted. A null cost is refused.

    What an account has spent depends on every call before, so its calls are read
    one after the other, as a stream with a few numbers of state: nothing of an
    account is held in memory, however many calls it has.
    """
    kinds = [("total", pa.float64()), ("admitted", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, [0.0, 0, 0]
        for batch in batches:
            totals, admitted = [], []
            for account, cost, own in zip(*(batch.column(c).to_pylist() for c in ("__account", "cost", "__tokens")), strict=True):
                if account != now:
                    now, used = account, [0.0, 0, 0]
                fits = cost is not None and used[0] + cost <= limit and (tokens is None or used[1] + own <= tokens) and (requests is None or used[2] < requests)
                if fits:
                    used = [used[0] + cost, used[1] + own, used[2] + 1]
                totals.append(float(used[0]))
                admitted.append(fits)
            added = [pa.array(v, kind) for v, (_, kind) in zip((totals, admitted), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names=[*batch.schema.names[:-2], *(n for n, _ in kinds)])

    own = F.coalesce(F.col("tokens"), F.lit(0)) if tokens is not None else F.lit(0)
    keyed = calls.withColumns({"__account": F.coalesce(F.col("account").cast("string"), F.lit("\0")), "__tokens": own.cast("long")})
    ordered = keyed.repartition("__account").sortWithinPartitions("__account", "seq")
    return ordered.mapInArrow(run, T.StructType([*calls.schema.fields, T.StructField("total", T.DoubleType()), T.StructField("admitted", T.BooleanType())]))


class Continuation:
    """Signed tokens that say where a query's next page begins."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def token(self, binding: dict, offset: int) -> str:
        body = json.dumps({"b": binding, "o": offset}, sort_keys=True, separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(hmac.new(self.secret, body, hashlib.sha256).digest() + body).decode().rstrip("=")

    def offset(self, token: str, binding: dict) -> int:
        """The offset; ValueError if the token isn't ours or is bound otherwise."""
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        except Exception as e:
            raise ValueError("not a continuation token") from e
        mac, body = raw[:32], raw[32:]
        if not hmac.compare_digest(mac, hmac.new(self.secret, body, hashlib.sha256).digest()):
            raise ValueError("not a continuation token")
        said = json.loads(body)
        if said["b"] != binding:
            raise ValueError("the token belongs to another request")
        return said["o"]

    @staticmethod
    def page(rows: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return rows.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + size))


def configuration_digest(configuration: object) -> str:
    return hashlib.sha256(json.dumps(asdict(configuration) if hasattr(configuration, "__dataclass_fields__") else configuration, sort_keys=True).encode()).hexdigest()
