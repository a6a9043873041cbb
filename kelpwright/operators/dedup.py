"""Deterministic de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_record(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (a total order).

    The rank filter is pushed before the shuffle as a group limit of one row a
    key and task, so a hot key does not gather its rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def drop_exact_repeats(df: DataFrame, ordinal: str, values: Sequence[str]) -> DataFrame:
    """One row per distinct values, its smallest ordinal, and how many it stands for."""
    return df.groupBy(*values).agg(F.min(ordinal).alias(ordinal), F.count(F.lit(1)).alias("copies"))


def keep_last_by_priority(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources where a later source replaces an earlier one's keys."""
    union = None
    for k, df in enumerate(frames):
        own = df.withColumn("__priority", F.lit(k))
        union = own if union is None else union.unionByName(own)
    return best_record(union, keys, [F.desc("__priority")]).drop("__priority")
