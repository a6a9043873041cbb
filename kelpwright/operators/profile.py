"""Profiles, distributions and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.operators.ranking import global_index

QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of each value, null included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__n")).alias("share"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, missing, cardinality, least, greatest, quantiles.

    Quantiles interpolate linearly and are exact; they are null for text.  One
    pass over the table for all columns.
    """
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        number = kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        value = F.col(c).cast("double")
        q = F.percentile(value, F.array(*map(F.lit, QUANTILES))) if number else F.lit(None).cast("array<double>")
        out.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), F.countDistinct(c).alias("cardinality"),
                F.min(F.col(c).cast("string") if not number else value).cast("string").alias("least"),
                F.max(F.col(c).cast("string") if not number else value).cast("string").alias("greatest"), q.alias("quantiles"),
            ).alias(c)
        )
    return df.agg(*out).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def split_summary(events: DataFrame) -> DataFrame:
    """Rows, positives, positive rate, users and items of each split."""
    positive = F.coalesce(F.col("long_view") & ~F.col("is_random"), F.lit(False))
    return events.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(positive).alias("positives"), F.avg(positive.cast("double")).alias("positive_rate"),
        F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"),
    )


def length_histogram(df: DataFrame, lists: str, longest: int = 50) -> DataFrame:
    """(length, n) for every length 0..longest, zeros included; longer ones too."""
    counts = df.groupBy(F.coalesce(F.size(F.coalesce(lists, F.array().cast("array<bigint>"))), F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(longest + 1).select(F.col("id").cast("int").alias("length"))
    return frame.join(counts, "length", "full").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def top_share(df: DataFrame, key: str, n: int) -> DataFrame:
    """One row: total, and what part of it the n most frequent keys hold."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    top = counts.orderBy(F.desc("c"), key).limit(n).agg(F.sum("c").alias("top"))
    return counts.agg(F.sum("c").alias("total")).crossJoin(F.broadcast(top)).select("total", (F.col("top") / F.col("total")).alias("share"))


def dataset_profile(ratings: DataFrame, user: str = "user_id", item: str = "item_id", few: int = 10) -> DataFrame:
    """One row: sizes, density, means, medians, and shares of the top items.

    The top 1 % and 10 % of items are at least one item, their number rounded
    half to even.
    """
    items = ratings.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_index(items, [F.desc("n"), F.col(item)], "at")
    users = ratings.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    base = ratings.agg(F.count(F.lit(1)).alias("ratings"), F.avg("rating").alias("mean_rating"))
    per_user = users.agg(F.count(F.lit(1)).alias("users"), F.percentile("n", F.lit(0.5)).alias("median_per_user"))
    per_item = items.agg(F.count(F.lit(1)).alias("items"), F.percentile("n", F.lit(0.5)).alias("median_per_item"), F.count_if(F.col("n") < few).alias("few_rated"))
    one = base.crossJoin(F.broadcast(per_user)).crossJoin(F.broadcast(per_item))
    head = lambda share: F.greatest(F.lit(1), F.bround(F.col("items") * share))
    tops = ranked.crossJoin(F.broadcast(per_item.select("items"))).agg(
        F.sum(F.when(F.col("at") < head(0.01), F.col("n"))).alias("top1"), F.sum(F.when(F.col("at") < head(0.10), F.col("n"))).alias("top10")
    )
    one = one.crossJoin(F.broadcast(tops))
    return one.select(
        "ratings", "users", "items", (F.col("ratings") / (F.col("users") * F.col("items"))).alias("density"), "mean_rating", "median_per_user", "median_per_item", "few_rated",
        (F.col("top1") / F.col("ratings")).alias("top1_share"), (F.col("top10") / F.col("ratings")).alias("top10_share"),
    )


def label_counts(df: DataFrame, column: str, separator: str, n: int) -> DataFrame:
    """The n most common parts of a separated list; ties by the part."""
    parts = df.select(F.explode(F.split(column, separator)).alias("label"))
    return parts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(n)


def popularity_percentiles(counts: DataFrame, item: str, count: str) -> DataFrame:
    """(item, percentile): average-method descending percentile rank.

    Ranks are taken over the distinct counts, of which there are few.
    """
    levels = counts.groupBy(count).agg(F.count(F.lit(1)).alias("ties"))
    # Distinct counts: at most the root of twice their sum.
    above = F.coalesce(F.sum("ties").over(Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("ties").over(Window.partitionBy())
    ranked = levels.select(count, ((above + 1 + (F.col("ties") - 1) / 2) / total).alias("percentile"))
    return counts.join(ranked, count).select(item, "percentile")


def head_concentration(relevant: DataFrame, percentiles: DataFrame, item: str = "item_id") -> DataFrame:
    """One row: share of relevant rows among the most popular 10 % and 20 %."""
    known = relevant.join(percentiles, item)
    share = lambda p: F.avg((F.col("percentile") <= p).cast("double"))
    return known.agg(F.count(F.lit(1)).alias("relevant"), share(0.1).alias("head10"), share(0.2).alias("head20"))


def group_means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns))


def fold_change(df: DataFrame, key: str, reference: object, metrics: Sequence[str]) -> DataFrame:
    """Each row's metrics over those of the reference row; null if that is 0."""
    base = df.where(F.col(key) == F.lit(reference)).select(*(F.col(m).alias(f"__{m}") for m in metrics)).limit(1)
    return df.crossJoin(F.broadcast(base)).select(key, *((F.col(m) / F.when(F.col(f"__{m}") != 0, F.col(f"__{m}"))).alias(m) for m in metrics))


def across_seeds(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population std over runs; one run has std 0."""
    return df.groupBy(*keys).agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))
