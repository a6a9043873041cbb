"""Iterative k-core filtering of a user-item graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwright.storage import Workspace


def _pass(df: DataFrame, key: str, least: int, least_rated: int) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") > 0).alias("rated"))
    return df.join(counts.where((F.col("n") >= least) & (F.col("rated") >= least_rated)).select(key), key, "left_semi")


def iterative_k_core(
    df: DataFrame, min_user: int, min_user_rated: int, min_item: int, min_item_rated: int, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """Rows that remain when thin users, then thin items, go until none does.

    Rounds work on (user, item, rating) alone, each written to the shared
    folder: lineage stays one round deep and only the row count reaches the
    driver.  The rows that stay are those of the users and items that do.
    """
    space = Workspace(df.sparkSession, "kcore")
    kept, n, round_ = df.select(user, item, "rating"), -1, 0
    while True:
        kept = space.write(_pass(_pass(kept, user, min_user, min_user_rated), item, min_item, min_item_rated), f"round{round_}")
        m = kept.count()
        if round_ > 0:
            space.drop(f"round{round_ - 1}")
        if m in (n, 0):
            break
        n, round_ = m, round_ + 1
    return df.join(kept.select(user).distinct(), user, "left_semi").join(kept.select(item).distinct(), item, "left_semi").select(df.columns)
