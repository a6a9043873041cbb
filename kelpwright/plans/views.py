"""Logical tables over the test tables, in DataFrames and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwright.operators.cleaning import information_score
from kelpwright.operators.dedup import best_record
from kelpwright.operators.text_ids import present_id
from kelpwright.plans.registry import table


def raw_ratings(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """Order lines as interactions; ``mixed``: returned lines are unrated."""
    rating = F.lit(1) + F.floor((F.col("l_quantity") - 1) / 10).cast("int")
    if mixed:
        rating = F.when(F.col("l_returnflag") == "R", 0).otherwise(rating)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"), (F.col("l_returnflag") != "N").alias("is_read"),
        (F.col("l_linestatus") == "F").alias("is_reviewed"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )
    return rows.withColumn("score", information_score())


def ratings(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """user_id, item_id, rating, is_read, is_reviewed, ts: the best row a pair."""
    order = [F.desc("score"), F.desc("ts"), F.desc("rating"), F.desc("is_read"), F.desc("is_reviewed")]
    return best_record(raw_ratings(spark, sf_dir, mixed), ["user_id", "item_id"], order).drop("score")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable interactions with trimmed ids."""
    rows = table(spark, sf_dir, "interactions").withColumns({"user_id": present_id("user_id"), "item_id": present_id("item_id"), "is_read": F.coalesce("is_read", F.lit(False))})
    return rows.where("user_id IS NOT NULL AND item_id IS NOT NULL AND event_time IS NOT NULL AND rating BETWEEN 0 AND 5")


def best_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_record(acts(spark, sf_dir), ["user_id", "item_id"], [F.desc_nulls_last("information_score"), F.desc("event_time"), F.asc("row_id")])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with user, item and time, one a request: its earliest."""
    rows = table(spark, sf_dir, "impressions").where("user_id IS NOT NULL AND item_id IS NOT NULL AND request_time_ms IS NOT NULL")
    first = F.min(F.struct("request_time_ms", "user_id", "item_id", F.coalesce("long_view", F.lit(False)).alias("long_view"), "is_random")).alias("s")
    return rows.groupBy("request_id").agg(first).select("request_id", "s.*")


_SPACES = "chr(32)||chr(9)||chr(10)||chr(13)||chr(160)"


def _raw_sql(mixed: bool) -> str:
    rating = "1 + CAST(floor((l_quantity - 1) / 10) AS INTEGER)"
    if mixed:
        rating = f"CASE WHEN l_returnflag = 'R' THEN 0 ELSE {rating} END"
    return f"""raw_ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST({rating} AS INTEGER) AS rating, l_returnflag <> 'N' AS is_read,
      l_linestatus = 'F' AS is_reviewed, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ratings AS (SELECT * FROM raw_ratings QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY
      CAST(rating > 0 AS INT) + CAST(is_read AS INT) + CAST(is_reviewed AS INT) DESC, ts DESC, rating DESC, is_read DESC, is_reviewed DESC) = 1)"""


RATINGS, MIXED = _raw_sql(False), _raw_sql(True)
ACTS = f"""acts AS (SELECT * FROM (SELECT row_id, trim(user_id, {_SPACES}) AS user_id, trim(item_id, {_SPACES}) AS item_id, rating, coalesce(is_read, false) AS is_read,
      is_reviewed, event_time, information_score FROM interactions) WHERE user_id <> '' AND item_id <> '' AND event_time IS NOT NULL AND rating BETWEEN 0 AND 5),
    best_acts AS (SELECT * FROM acts QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY information_score DESC NULLS LAST, event_time DESC, row_id) = 1)"""
EVENTS = """ev AS (SELECT request_id, request_time_ms, user_id, item_id, coalesce(long_view, false) AS long_view, is_random FROM impressions
      WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND request_time_ms IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY request_time_ms, user_id, item_id, coalesce(long_view, false), is_random) = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n    ".join(parts) + "\n"
