"""Popularity and bias baselines, popularity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.operators.ranking import global_index
from kelpwright.storage import Workspace


def popularity(train: DataFrame, item: str = "item_id") -> DataFrame:
    return train.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def candidate_popularity(candidates: DataFrame, train: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, n) of every candidate; 0 without training events."""
    return candidates.select(item).distinct().join(popularity(train, item), item, "left").select(item, F.coalesce("n", F.lit(0)).alias("n"))


def bayesian_popularity(train: DataFrame, weight: float = 25.0, item: str = "item_id") -> DataFrame:
    """(item, n, score): mean rating drawn to the global mean by ``weight`` votes."""
    per = train.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"))
    mean = train.agg(F.avg("rating").alias("mu"))
    return per.crossJoin(F.broadcast(mean)).select(item, "n", ((F.col("s") + weight * F.col("mu")) / (F.col("n") + weight)).alias("score"))


def popular_unseen(scores: DataFrame, seen: DataFrame, n: int, user: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """(user, item, rank): each user's n best items of one global order, unseen.

    A user who has seen m items finds the n best unseen ones among the first
    n + m places of the order, so each user subtracts own places from as many
    and no user-by-item product is formed; a busy user costs only itself.
    """
    pairs = seen.select(user, item).distinct()
    order = [F.desc(score), F.asc(item)]
    place = Workspace(seen.sparkSession, "popular").write(global_index(scores.select(item, score), order, "place").select(F.col("place").cast("int").alias("place"), item), "place")
    size = place.count()
    own = pairs.join(place, item, "left").groupBy(user).agg(F.collect_list("place").alias("own"))
    upto = F.least(F.lit(size), F.size("own") + n) - 1
    left = F.slice(F.array_except(F.when(upto >= 0, F.sequence(F.lit(0), upto)).otherwise(F.array().cast("array<int>")), "own"), 1, n)
    lists = own.select(user, F.posexplode(left).alias("at", "place")).join(place, "place")
    return lists.select(user, item, (F.col("at") + 1).alias("rank"))


def fit_biases(
    train: DataFrame, passes: int = 10, user_reg: float = 10.0, item_reg: float = 10.0, user: str = "user_id", item: str = "item_id"
) -> tuple[float, DataFrame, DataFrame]:
    """Global mean, user biases and item biases by alternating passes.

    A user pass sees the item biases before it, an item pass the new user
    biases; both divide by count + regularisation.  The item biases, one row per
    item, are written each pass, so lineage is one pass deep.
    """
    space = Workspace(train.sparkSession, "bias")
    rows = space.write(train.select(user, item, F.col("rating").cast("double").alias("rating")), "rows")
    mean = rows.agg(F.avg("rating")).first()[0]
    items = rows.select(item).distinct().withColumn("bi", F.lit(0.0))
    users = rows.select(user).distinct().withColumn("bu", F.lit(0.0))
    for k in range(passes):
        gap = F.sum(F.col("rating") - mean - F.col("bi")) / (F.count(F.lit(1)) + user_reg)
        users = rows.join(items, item).groupBy(user).agg(gap.alias("bu"))
        if k == passes - 1:
            users = space.write(users, "users")
        gap = F.sum(F.col("rating") - mean - F.col("bu")) / (F.count(F.lit(1)) + item_reg)
        items = space.write(rows.join(users, user).groupBy(item).agg(gap.alias("bi")), f"items{k}")
        if k:
            space.drop(f"items{k - 1}")
    space.drop("rows")
    return mean, users, items


def predict_biases(pairs: DataFrame, model: tuple[float, DataFrame, DataFrame], user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``pairs`` with ``raw``; an unknown user or item adds nothing."""
    mean, users, items = model
    joined = pairs.join(users, user, "left").join(items, item, "left")
    return joined.withColumn("raw", F.lit(mean) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0))).drop("bu", "bi")


def top_per_user(scored: DataFrame, n: int, user: str = "user_id", item: str = "item_id", score: str = "score", secondary: tuple[str, ...] = ()) -> DataFrame:
    """The n best entries of each user with ``rank``; ties by secondary, then id."""
    order = [F.desc(score), *(F.desc_nulls_last(s) for s in secondary), F.asc(item)]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("rank") <= n)
