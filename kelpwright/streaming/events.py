"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ms: str = "request_time_ms", delay: str = "10 minutes") -> DataFrame:
    """``ts`` from epoch ms, watermarked; rows without a time cannot be placed."""
    return events.where(F.col(ms).isNotNull()).withColumn("ts", F.timestamp_millis(ms)).withWatermark("ts", delay)


def windowed_views(events: DataFrame, window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(start, item_id, n, long_views) of tumbling or sliding windows."""
    of = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.groupBy(of, "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("long_view").alias("long_views"))
    return counts.select(F.col("window.start").alias("start"), "item_id", "n", "long_views")


def streaming_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n_events) of sessions closed by the watermark.

    ``end`` is the last event plus the gap, as session windows define it; a gap
    of exactly ``gap`` ends a session here, while the batch operator keeps it.
    """
    rows = events.where("user_id IS NOT NULL").groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def first_requests(events: DataFrame) -> DataFrame:
    """Requests de-duplicated within the watermark."""
    return events.dropDuplicatesWithinWatermark(["request_id"])


_STATE = "times array<bigint>, items array<bigint>"
_OUT = "user_id long, request_id string, history_item_ids array<bigint>"


def streaming_histories(positives: DataFrame, limit: int = 50) -> DataFrame:
    """Strictly prior histories of positive events, per user, as they arrive.

    State: the user's last items and times, at most ``limit`` instants older
    than the newest.  Within a micro-batch events are replayed in time order;
    an event older than the state sees only what is strictly earlier than it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, items = map(list, state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values(["request_time_ms", "request_id"])
        out = []
        for r in new.itertuples():
            past = [i for t, i in zip(times, items, strict=True) if t < r.request_time_ms][-limit:]
            out.append((key[0], r.request_id, past))
            times.append(int(r.request_time_ms))
            items.append(int(r.item_id))
        order = sorted(range(len(times)), key=lambda k: times[k])
        times, items = [times[k] for k in order], [items[k] for k in order]
        # Keep limit items older than the newest instant, and that instant's own.
        older = sum(t < times[-1] for t in times)
        cut = max(0, older - limit)
        state.update((times[cut:], items[cut:]))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "history_item_ids"])

    return positives.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
