"""Queries of the general training-data problems: sessions, as-of, skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwright.operators.asof import attributes_as_known, request_items
from kelpwright.operators.sessions import sessionize
from kelpwright.operators.skew import counts_per_key
from kelpwright.operators.text_ids import present_id, trim_id
from kelpwright.plans.registry import Registry, table
from kelpwright.storage import Workspace

registry = Registry()


@registry.query(
    "p3_found",
    """
    WITH rows_ AS (SELECT request_id, user_id, request_time_ms AS t, tab FROM impressions WHERE user_id IS NOT NULL AND request_time_ms IS NOT NULL),
    one AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY t, user_id, tab NULLS LAST) = 1),
    gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, request_id) <= 1800000 THEN 0 ELSE 1 END AS opens FROM one),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
    SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_events, count(DISTINCT tab) AS n_tabs
    FROM numbered GROUP BY user_id, s
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(table(spark, sf_dir, "impressions"))


@registry.query(
    "p5_found",
    """
    WITH req AS (SELECT DISTINCT request_id, time_ms, item_id, history_item_ids FROM validation WHERE time_ms IS NOT NULL),
    pairs AS (
      SELECT DISTINCT request_id, time_ms, i AS item_id
      FROM (SELECT request_id, time_ms, unnest(list_append(coalesce(history_item_ids, []), item_id)) AS i FROM req) WHERE i IS NOT NULL)
    SELECT p.request_id, p.item_id, c.version_no
    FROM pairs p JOIN candidates c ON c.item_id = p.item_id AND c.eligible_after_ms <= p.time_ms AND c.first_observed_ms <= p.time_ms
    QUALIFY row_number() OVER (PARTITION BY p.request_id, p.item_id ORDER BY c.eligible_after_ms DESC, c.version_no DESC) = 1
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Workspace(spark, "requests").write(request_items(table(spark, sf_dir, "validation")), "events")
    return attributes_as_known(events, table(spark, sf_dir, "candidates")).select("request_id", "item_id", "version_no")


@registry.query(
    "p6_found",
    """
    WITH inter AS (SELECT trim(item_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) AS item_id,
                          nullif(trim(user_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)), '') AS user_id FROM interactions WHERE item_id IS NOT NULL)
    SELECT 'impressions' AS table_name, CAST(item_id AS VARCHAR) AS item_id, count(DISTINCT request_id) AS n_records, count(DISTINCT user_id) AS n_users
    FROM impressions WHERE item_id IS NOT NULL GROUP BY item_id
    UNION ALL
    SELECT 'interactions', item_id, count(*), count(DISTINCT user_id) FROM inter GROUP BY item_id
    """,
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = counts_per_key(table(spark, sf_dir, "impressions"), "item_id", "request_id", "user_id")
    acts = table(spark, sf_dir, "interactions").select(trim_id("item_id").alias("item_id"), present_id("user_id").alias("user_id"))
    acts = counts_per_key(acts, "item_id", None, "user_id")
    columns = ("table_name", F.col("item_id").cast("string").alias("item_id"), "n_records", "n_users")
    return (
        logs.withColumn("table_name", F.lit("impressions")).select(*columns)
        .unionByName(acts.withColumn("table_name", F.lit("interactions")).select(*columns))
    )
