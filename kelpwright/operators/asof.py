"""Attributes as known at event time, from periodic snapshots and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.storage import Workspace

DAY_MS = 86_400_000
#: Stored in place of an unknown eligibility time.
UNKNOWN_MS = 9_223_372_036_854_775_807


def known_changes(versions: DataFrame, item: str, version: str, valid_from: str, known_from: str) -> DataFrame:
    """Change log (item, eff, valid_ms, version): one row per instant and item.

    A version takes effect once it is both valid and on record.  Rows with a
    null item or version, or with either time null or unknown, never do and are
    left out; whole repeats and versions beaten at the same instant collapse.
    """
    rows = versions.select(
        F.col(item).alias("item"), F.col(valid_from).alias("valid_ms"), F.col(known_from).alias("known_ms"), F.col(version).alias("version")
    ).where(
        f"item IS NOT NULL AND version IS NOT NULL AND valid_ms < {UNKNOWN_MS} AND known_ms < {UNKNOWN_MS}"
    )
    best = F.max(F.struct("valid_ms", "version")).alias("best")
    return rows.groupBy("item", F.greatest("valid_ms", "known_ms").alias("eff")).agg(best)


def as_known_states(changes: DataFrame, wanted: DataFrame, period_ms: int) -> DataFrame:
    """(item, period, eff, best): the snapshot at its start and the changes within it.

    Of the (item, period) pairs in ``wanted`` only; a snapshot has the smallest
    possible ``eff``.  Periods come from the events, not from a calendar: one
    odd time costs one snapshot.
    """
    keys = ["item", "period"]
    changes = changes.withColumn("period", F.floor(F.col("eff") / F.lit(period_ms)).cast("long"))
    changes = changes.join(wanted.select("item").distinct(), "item", "left_semi")
    ends = changes.groupBy(*keys).agg(F.max("best").alias("best")).withColumn("asks", F.lit(0))
    asks = wanted.withColumns({"best": F.lit(None).cast(dict(ends.dtypes)["best"]), "asks": F.lit(1)})
    # Of a period's rows the asking one comes first: it sees earlier periods alone.
    upto = Window.partitionBy("item").orderBy("period", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = ends.unionByName(asks).withColumn("best", F.max("best").over(upto)).where("asks = 1 AND best IS NOT NULL")
    snapshots = known.select(*keys, F.lit(-(2**63)).cast("long").alias("eff"), "best")
    return snapshots.unionByName(changes.join(wanted, keys, "left_semi").select(*keys, "eff", "best"))


def replay(log: Column, at: Column) -> Column:
    """The best (valid_ms, version) among the log entries in effect at ``at``."""
    return F.array_max(F.transform(F.filter(log, lambda x: x["eff"] <= at), lambda x: x["best"]))


def attributes_as_known(
    events: DataFrame,
    versions: DataFrame,
    event_item: str = "item_id",
    event_time: str = "time_ms",
    item: str = "item_id",
    version: str = "version_no",
    valid_from: str = "eligible_after_ms",
    known_from: str = "first_observed_ms",
    period_ms: int = 30 * DAY_MS,
    log_entries: int = 256,
) -> DataFrame:
    """Each event with the version of its item valid and on record at its time.

    Of the versions with valid_from <= time and known_from <= time the one with
    the greatest valid_from, then the greatest version, is taken.  All columns
    of ``events`` are kept; ``version_no`` and ``valid_from_ms`` are added (an
    existing column of these names is replaced).  Events with a null time or
    item, and events before their item's first version, have no result row.
    Times may be any: negative, or far in the future.

    Snapshots and logs are written to the shared folder.  Each event meets one
    row, that of (item, period of its time), and replays its log: an equi-join
    which AQE splits where an item's events are many.  Where an item has more
    than ``log_entries`` changes in a period, events and changes are replayed as
    one ordered stream instead of a list per event; both ways give the same.
    """
    space = Workspace(events.sparkSession, "asof")
    period = F.floor(F.col("at") / F.lit(period_ms)).cast("long")
    keep = [c for c in events.columns if c not in ("version_no", "valid_from_ms")]
    keyed = events.select(F.struct(*keep).alias("event"), F.col(event_item).alias("item"), F.col(event_time).alias("at"))
    keyed = keyed.where("item IS NOT NULL AND at IS NOT NULL").withColumn("period", period)
    wanted = space.write(keyed.select("item", "period").distinct(), "wanted")
    changes = known_changes(versions, item, version, valid_from, known_from)
    entries = space.write(as_known_states(changes, wanted, period_ms), "entries")
    keys = ["item", "period"]
    long = space.write(entries.groupBy(*keys).count().where(F.col("count") > log_entries).select(*keys), "long")
    streamed = not long.isEmpty()
    short = entries.join(long, keys, "left_anti") if streamed else entries
    states = space.write(short.groupBy(*keys).agg(F.collect_list(F.struct("eff", "best")).alias("log")), "states")
    found = keyed.join(states, keys).select("event", replay(F.col("log"), F.col("at")).alias("best"))
    if streamed:
        asks = keyed.join(long, keys, "left_semi").select(*keys, "at", F.lit(1).alias("asks"), "event", F.lit(None).cast(dict(entries.dtypes)["best"]).alias("best"))
        told = entries.join(long, keys, "left_semi").select(*keys, F.col("eff").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast(dict(keyed.dtypes)["event"]).alias("event"), "best")
        upto = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        replayed = asks.unionByName(told).withColumn("best", F.max("best").over(upto)).where("asks = 1").select("event", "best")
        found = found.unionByName(replayed)
    return found.where("best IS NOT NULL").select("event.*", F.col("best.version").alias("version_no"), F.col("best.valid_ms").alias("valid_from_ms"))


def request_items(requests: DataFrame, request: str = "request_id", time: str = "time_ms", item: str = "item_id", history: str = "history_item_ids") -> DataFrame:
    """(request_id, item_id, time_ms): a request's items and those of its history.

    One row per request and item, whatever the number of rows of a request; of
    an item that a request has at several times the latest counts, at which all
    that was known earlier is known too.  Null and empty histories, null items
    and null elements give no row of their own; requests with a null id or time
    are left out.
    """
    items = F.concat(F.array(item), F.coalesce(F.col(history), F.array().cast("array<bigint>")))
    rows = requests.where(F.col(request).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(request).alias("request_id"), F.col(time).alias("time_ms"), F.explode(items).alias("item_id")).where("item_id IS NOT NULL")
    return rows.groupBy("request_id", "item_id").agg(F.max("time_ms").alias("time_ms"))
