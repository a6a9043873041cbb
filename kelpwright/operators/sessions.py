"""Grouping activity into sessions separated by idle gaps.

Lag flags a gap, a running sum of the flags numbers the sessions, an aggregate
describes them.  A user's events are first windowed per (user, block of time)
so that even a user holding a third of all rows is spread over the blocks;
the block-level sessions, a few per user and block, are then joined across
block borders by the same lag and running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def first_occurrence(df: DataFrame, event: str, user: str, time: str, tab: str) -> DataFrame:
    """One row per event id: that of its smallest time.

    Rows whose user or time is null are left out first; rows without an event
    id cannot be told apart and count once each distinct (user, time, tab).
    Equal times are settled by the smallest user, then the smallest tab with
    null last.  Columns out: user_id, t, tab.
    """
    rows = df.select(
        F.col(event).alias("e"), F.col(user).alias("user_id"), F.col(time).cast("long").alias("t"), F.col(tab).alias("tab")
    ).where("user_id IS NOT NULL AND t IS NOT NULL")
    firsts = (
        rows.where("e IS NOT NULL")
        .groupBy("e")
        .agg(F.min(F.struct("t", "user_id", F.col("tab").isNull().alias("no_tab"), "tab")).alias("s"))
        .select("s.user_id", "s.t", "s.tab")
    )
    anonymous = rows.where("e IS NULL").select("user_id", "t", "tab").distinct()
    return firsts.unionByName(anonymous)


def sessionize(
    df: DataFrame,
    user: str = "user_id",
    time: str = "request_time_ms",
    event: str = "request_id",
    tab: str = "tab",
    gap_ms: int = 1_800_000,
    block_ms: int = DAY_MS,
) -> DataFrame:
    """Sessions of each user: user_id, start_ms, end_ms, n_events, n_tabs.

    A session ends where the user's next event is more than ``gap_ms`` later;
    a gap of exactly ``gap_ms`` does not end it.  Null users and times are left
    out, an event id counts once at its smallest time, null tabs do not count
    as tabs, an empty table gives no sessions, and other columns are ignored.

    Work per task is bounded by a block of one user, equal times of which are
    aggregated before the window: at most ``block_ms`` instants whatever the
    number of rows.  Gaps too wide for a long end a session.
    """
    first = first_occurrence(df, event, user, time, tab)
    # One exchange serves the instants, the window and the sessions of a block.
    moments = (
        first.withColumn("block", F.floor(F.col("t") / F.lit(block_ms)))
        .repartition("user_id", "block")
        .groupBy("user_id", "block", "t")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_set("tab").alias("tabs"))
    )
    within = Window.partitionBy("user_id", "block").orderBy("t")
    opens = F.coalesce((F.try_subtract("t", F.lag("t").over(within)) > gap_ms).cast("int"), F.lit(1))
    partial = (
        moments.withColumn("opens", opens)
        .withColumn("s", F.sum("opens").over(within))
        .groupBy("user_id", "block", "s")
        .agg(
            F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.sum("n").alias("n"),
            F.array_distinct(F.flatten(F.collect_set("tabs"))).alias("tabs"),
        )
    )
    across = Window.partitionBy("user_id").orderBy("start_ms")
    opens = F.coalesce((F.try_subtract("start_ms", F.lag("end_ms").over(across)) > gap_ms).cast("int"), F.lit(1))
    return (
        partial.withColumn("opens", opens)
        .withColumn("s", F.sum("opens").over(across))
        .groupBy("user_id", "s")
        .agg(
            F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n_events"),
            F.size(F.array_distinct(F.flatten(F.collect_set("tabs")))).cast("long").alias("n_tabs"),
        )
        .drop("s")
    )
