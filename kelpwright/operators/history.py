"""Leakage-safe histories of items."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_histories(events: DataFrame, limit: int = 50, user: str = "user_id", time: str = "request_time_ms", item: str = "item_id", request: str = "request_id") -> DataFrame:
    """(request, history_item_ids): the user's items of strictly earlier times.

    Oldest first, the last ``limit``; equal times are ordered by request.  The
    items of one instant are gathered first, so a window of ``limit`` instants
    holds the history whatever the ties and no unbounded list is built.
    """
    at = F.array_sort(F.collect_list(F.struct(F.col(request).alias("r"), F.col(item).alias("i"))))
    instants = events.where(F.col(user).isNotNull() & F.col(time).isNotNull()).groupBy(user, time).agg(at.alias("__at"))
    tail = F.slice("__at", F.greatest(F.size("__at") - limit + 1, F.lit(1)), limit)
    before = Window.partitionBy(user).orderBy(time).rowsBetween(-limit, -1)
    past = F.flatten(F.collect_list(F.transform(tail, lambda x: x["i"])).over(before))
    rows = instants.withColumn("__past", past).withColumn("h", F.slice("__past", F.greatest(F.size("__past") - limit + 1, F.lit(1)), limit))
    return rows.select(F.explode("__at").alias("e"), "h").select(F.col("e.r").alias(request), F.col("h").alias("history_item_ids"))


def completed_histories(
    events: DataFrame, limit: int = 50, user: str = "user_id", item: str = "item_id", time: str = "time_ms", available: str = "available_ms", ordinal: str = "ordinal"
) -> DataFrame:
    """(user, ordinal, history_item_ids): items whose feedback was there before.

    An item is visible to a request if its ``available`` time is strictly
    smaller than the request's time; visible items keep their request order
    (``ordinal``) and the last ``limit`` count.  Requests and publications are
    replayed as one ordered stream a user, requests first at equal times; of
    what is visible only the last ``limit`` are held, whatever the user's number
    of events.
    """
    ask = events.select(F.col(user).alias("u"), F.col(time).alias("ts"), F.lit(0).alias("kind"), F.col(ordinal).cast("long").alias("o"), F.lit(None).cast("long").alias("i"))
    tell = events.select(F.col(user).alias("u"), F.col(available).alias("ts"), F.lit(1).alias("kind"), F.col(ordinal).cast("long").alias("o"), F.col(item).cast("long").alias("i"))
    stream = ask.unionByName(tell.where("ts IS NOT NULL")).repartition("u").sortWithinPartitions("u", "ts", "kind", "o", "i")
    kind = dict(events.dtypes)[user]
    lists = stream.mapInArrow(_replay(limit), f"u {kind}, o bigint, h array<bigint>")
    return lists.select(F.col("u").alias(user), F.col("o").cast(dict(events.dtypes)[ordinal]).alias(ordinal), F.col("h").alias("history_item_ids"))


def _replay(limit: int):
    """(u, o, h) of the asking rows of a stream sorted by user, time and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, visible = None, []  # the last ``limit`` of (ordinal, place in the stream, item)
        n = 0
        for batch in batches:
            users, kinds, ordinals, items = (batch.column(c).to_pylist() for c in ("u", "kind", "o", "i"))
            rows, flat, offsets = [], [], [0]
            for at, (u, kind, o, i) in enumerate(zip(users, kinds, ordinals, items, strict=True)):
                if u != user:
                    user, visible = u, []
                n += 1
                if kind:
                    if len(visible) < limit or (o, n) > visible[0][:2]:
                        bisect.insort(visible, (o, n, i))
                        del visible[:-limit]
                else:
                    rows.append(at)
                    flat.extend(v[2] for v in visible)
                    offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(take), batch.column("o").take(take), lists], names=["u", "o", "h"])

    return run


def history_drift(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: requests compared and how many histories differ."""
    both = a.join(b.withColumnRenamed("history_item_ids", "other"), key)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("history_item_ids").eqNullSafe(F.col("other"))).alias("drifted"))


def implicit_items(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, items): each user's distinct items, ascending."""
    return df.groupBy(user).agg(F.array_sort(F.collect_set(item)).alias("items"))


def first_observed(events: DataFrame, item: str = "item_id", time: str = "request_time_ms") -> DataFrame:
    return events.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(time).alias("eligible_after_ms"))
