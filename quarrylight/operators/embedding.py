"""Embedding of texts: a deterministic test double, batches with retry, profiles."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must be equal for vectors of one profile to serve another.
IDENTITY = ("provider", "model", "model_version", "dimension", "normalized")


def seeded_vectors(dimension: int, normalize: bool = True) -> Callable[[list[str]], list[list[float]]]:
    """A provider without a model: components from the SHA-256 of text and index."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-dimension // 8)))
            v = np.frombuffer(raw, "<u4")[:dimension] / 2**31 - 1.0
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if normalize and n > 0 else v).tolist())
        return out

    return embed


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 64, attempts: int = 3, backoff: float = 0.1, deadline: float = 60.0) -> DataFrame:
    """content_hash, vector, error for each row of ``texts`` (content_hash, content).

    Batches go to the provider with bounded retries, none begun beyond the
    deadline of a batch; one that fails for good gives rows with its first error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                began, first, vectors = time.monotonic(), None, None
                for attempt in range(attempts):
                    try:
                        vectors = provider(part["content"].fillna("").tolist())
                        break
                    except Exception as e:  # noqa: BLE001 - a provider's failure is a row
                        first = first or f"{type(e).__name__}: {e}"[:200]
                        pause = backoff * 2**attempt
                        if time.monotonic() + pause - began > deadline:
                            break
                        time.sleep(pause)
                failed = vectors is None or len(vectors) != len(part)
                yield pd.DataFrame({"content_hash": part["content_hash"].tolist(), "vector": [None] * len(part) if failed else vectors, "error": [(first or "wrong number of vectors") if failed else None] * len(part)})

    return texts.select("content_hash", "content").mapInPandas(run, "content_hash string, vector array<double>, error string")


def compatible(a: str, b: str) -> Column:
    """Whether the profiles in two struct columns share their identity."""
    out = F.lit(True)
    for c in IDENTITY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def to_rebuild(items: DataFrame, profile: dict) -> DataFrame:
    """Items with whether their vector can serve the profile or must be made anew."""
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.lit(profile[c]))
    return items.withColumn("action", F.when(same & (F.col("state") == "ready"), "reuse").otherwise("rebuild"))
