"""The ingestion job queue as a stream of events, and windows on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("load", "canonical", "text", "relational", "vector", "activate")
_ENDED = ("completed", "partial", "failed", "cancelled")
_STATE = "state string, stage int, attempt int, lease_until long, processed long"
OUTPUT = "job_id string, seq long, event string, accepted boolean, state string, stage int, attempt int, processed long"


def advance(job: dict, event: dict) -> tuple[dict, bool]:
    """A job after an event, and whether the event was allowed.

    claim: from pending, partial (resume) or once the lease ends; heartbeat, advance
    (same stage or the next), complete, partial, fail: by a live lease; cancel:
    unless ended. Counters never fall.
    """
    now, name = event["at"], event["event"]
    live = job["state"] == "running" and now < job["lease_until"]
    new = dict(job)
    if name == "claim":
        if job["state"] in ("pending", "partial") or (job["state"] == "running" and not live):
            new |= {"state": "running", "attempt": job["attempt"] + 1, "lease_until": now + event["lease"]}
            return new, True
    elif name == "cancel":
        if job["state"] not in _ENDED:
            return new | {"state": "cancelled"}, True
    elif live:
        if name == "heartbeat":
            return new | {"lease_until": now + event["lease"]}, True
        if name == "advance" and event["stage"] - job["stage"] in (0, 1) and event["stage"] < len(STAGES) and event["processed"] >= job["processed"]:
            return new | {"stage": event["stage"], "processed": event["processed"]}, True
        if name == "complete" and job["stage"] == len(STAGES) - 1:
            return new | {"state": "completed"}, True
        if name in ("partial", "fail"):
            return new | {"state": "partial" if name == "partial" else "failed"}, True
    return job, False


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _STATE.split(", ")]
    job = dict(zip(names, state.get, strict=True)) if state.exists else {"state": "pending", "stage": 0, "attempt": 0, "lease_until": 0, "processed": 0}
    rows = []
    events = pd.concat(list(batches))
    for e in events.sort_values("seq").to_dict("records"):
        job, accepted = advance(job, e)
        rows.append((key[0], e["seq"], e["event"], accepted, job["state"], job["stage"], job["attempt"], job["processed"]))
    state.update(tuple(job[n] for n in names))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def job_states(events: DataFrame) -> DataFrame:
    """A stream (or table) of job events -> each with the state it leads to.

    ``events``: job_id, seq, event, at, lease, stage, processed.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    if events.isStreaming:
        return events.groupBy("job_id").applyInPandasWithState(_step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)

    class Fresh:
        exists = False

        def update(self, value) -> None:
            pass

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_step(key, iter([pdf]), Fresh())))

    return events.groupBy("job_id").applyInPandas(one, OUTPUT)


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums per type and tumbling window, with a watermark on streams.
    An extension: there are no event-time windows among the engine's own operators."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
