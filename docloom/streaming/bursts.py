"""Streaming audit: login-failure bursts and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_alerts(events: DataFrame, key: str = "user_id", minutes: int = 10, threshold: int = 5, late: str = "1 minute") -> DataFrame:
    """AUD-04 as a stream: alerts (key, created_at, n) of events(key, event_id, created_at).

    State of a key: times of the last `minutes` and the last alert; it is dropped by an event-time timeout.
    Events later than the watermark are dropped by the engine. Within one batch rows are taken in time order.
    """
    span = minutes * 60_000_000

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        out = []
        for t, e in zip(rows["created_at"], rows["event_id"]):
            us = int(t.value // 1000) if t.unit == "ns" else int(pd.Timestamp(t).as_unit("us").value)
            times = [x for x in times if x >= us - span] + [us]
            if len(times) >= threshold and (last is None or us - last > span):
                last = us
                out.append((k[0], int(e), t, len(times)))
        state.update((times, last))
        edge = max(times) // 1000 + minutes * 60_000
        state.setTimeoutTimestamp(max(edge, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "event_id", "created_at", "n"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "created_at").withWatermark("created_at", late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, created_at timestamp, n bigint", "times array<bigint>, last bigint", "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type, final once the watermark has passed."""
    w = events.withWatermark("created_at", late).groupBy(F.window("created_at", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
