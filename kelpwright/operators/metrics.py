"""Ranking, rating, coverage and significance metrics over long-form lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.operators.ranking import equal_count_bucket, global_index


def ideal_gain(n: Column) -> Column:
    """Gain of n hits at ranks 1..n."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))


def user_ranking_metrics(recs: DataFrame, truth: DataFrame, k: int, user: str = "user_id", item: str = "item_id", rank: str = "rank") -> DataFrame:
    """Per user with any truth: hit, precision, recall and NDCG at k.

    Precision divides by k even if the list is shorter.  Users without a list
    score 0.
    """
    relevant = truth.select(user, item).distinct()
    sizes = relevant.groupBy(user).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = recs.where(F.col(rank) <= k).join(relevant, [user, item])
    gains = hits.groupBy(user).agg(F.count(F.lit(1)).alias("n_hit"), F.sum(1 / F.log2(F.col(rank) + F.lit(1.0))).alias("gain"))
    rows = sizes.join(gains, user, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "gain": F.coalesce("gain", F.lit(0.0))})
    return rows.select(
        user, (F.col("n_hit") > 0).cast("double").alias("hit"), (F.col("n_hit") / k).alias("precision"), (F.col("n_hit") / F.col("n_rel")).alias("recall"),
        (F.col("gain") / ideal_gain(F.least("n_rel", F.lit(k)))).alias("ndcg"),
    )


def macro_means(per_user: DataFrame) -> DataFrame:
    """One row: users and the mean of each metric over them."""
    return per_user.agg(F.count(F.lit(1)).alias("users"), *(F.avg(m).alias(m) for m in ("hit", "precision", "recall", "ndcg")))


def single_target_metrics(ranked: DataFrame, k: int, rank: str = "rank", covered: str = "covered") -> DataFrame:
    """One row over requests of one target each.

    Uncovered targets stay in the denominator as misses; the conditional recall
    is over covered ones and null if there are none.
    """
    hit = F.coalesce((F.col(rank) <= k) & F.col(covered), F.lit(False))
    gain = F.when(hit, 1 / F.log2(F.col(rank) + F.lit(1.0))).otherwise(0.0)
    return ranked.agg(
        F.count(F.lit(1)).alias("requests"), F.avg(hit.cast("double")).alias("recall"), F.avg(gain).alias("ndcg"),
        F.avg(F.when(F.col(covered), hit.cast("double"))).alias("covered_recall"), F.avg(F.col(covered).cast("double")).alias("coverage"),
    )


def coverage_decomposition(ranked: DataFrame, k: int, rank: str = "rank", covered: str = "covered") -> DataFrame:
    """One row: uncovered, covered misses and hits, which add up to all."""
    hit = F.coalesce((F.col(rank) <= k) & F.col(covered), F.lit(False))
    return ranked.agg(F.count_if(~F.col(covered)).alias("uncovered"), F.count_if(F.col(covered) & ~hit).alias("missed"), F.count_if(hit).alias("hits"))


def rating_errors(pairs: DataFrame, actual: str, predicted: str, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """One row: count, RMSE and MAE of predictions clipped to the scale; unrated rows do not count."""
    clipped = F.least(F.greatest(F.col(predicted), F.lit(low)), F.lit(high))
    e = clipped - F.col(actual)
    rated = pairs.where((F.col(actual) > 0) & F.col(predicted).isNotNull())
    return rated.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def list_statistics(recs: DataFrame, counts: DataFrame, catalog_size: int, item: str = "item_id", count: str = "n", head_share: float = 0.2) -> DataFrame:
    """One row: catalog coverage, long-tail share and novelty of the lists.

    The head is the ceiling of ``head_share`` of the items, most frequent
    first, ties by id; novelty is the mean of -log2 of an item's share of all
    interactions, an unseen item counting as seen once.
    """
    n = counts.count()
    head = counts.orderBy(F.desc(count), item).limit(int(np.ceil(head_share * n))).select(item, F.lit(True).alias("head"))
    total = counts.agg(F.sum(count).alias("total"))
    rows = recs.join(counts.select(item, count), item, "left").join(head, item, "left").crossJoin(F.broadcast(total))
    novelty = -F.log2(F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)) / F.col("total"))
    return rows.agg(
        (F.countDistinct(item) / F.lit(catalog_size)).alias("coverage"), F.avg(F.when(F.col("head"), 0.0).otherwise(1.0)).alias("long_tail"), F.avg(novelty).alias("novelty")
    )


def tie_statistics(recs: DataFrame, user: str, score: str) -> DataFrame:
    """One row: lists, share fully tied, share of entries in ties, largest tie."""
    groups = recs.groupBy(user, score).agg(F.count(F.lit(1)).alias("n"))
    lists = groups.groupBy(user).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied"))
    return lists.agg(
        F.count(F.lit(1)).alias("lists"), F.avg(((F.col("most") == F.col("n")) & (F.col("n") > 1)).cast("double")).alias("fully_tied"),
        (F.sum("tied") / F.sum("n")).alias("entries_tied"), F.max("most").alias("largest"),
    )


def list_quality(recs: DataFrame, score: str, fallback: str, high: float = 5.0, low: float = 1.0) -> DataFrame:
    """One row: shares of fallback entries, of scores above the scale, of clipped ones."""
    s = F.col(score)
    return recs.agg(
        F.avg(F.col(fallback).cast("double")).alias("fallback_share"), F.avg((s > high).cast("double")).alias("above_share"), F.avg(((s > high) | (s < low)).cast("double")).alias("clipped_share")
    )


def activity_segments(per_user: DataFrame, activity: DataFrame, user: str, count: str, names: tuple[str, ...] = ("sparse", "light", "active", "power")) -> DataFrame:
    """Metric means by equal-count segment of training activity (ties by id)."""
    placed = global_index(per_user.join(activity, user), [F.col(count), F.col(user)], "at")
    n = placed.agg(F.count(F.lit(1)).alias("__n"))
    bucket = equal_count_bucket(F.col("at") + 1, F.col("__n"), len(names))
    rows = placed.crossJoin(F.broadcast(n)).withColumn("segment", F.element_at(F.array(*map(F.lit, names)), bucket))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("users"), F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


def paired_differences(candidate: DataFrame, baseline: DataFrame, user: str, metric: str) -> DataFrame:
    return candidate.select(user, F.col(metric).alias("a")).join(baseline.select(user, F.col(metric).alias("b")), user).select(user, (F.col("a") - F.col("b")).alias(metric))


def bootstrap_interval(per_user: DataFrame, user: str, metric: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean and 95 % interval over resamples of users.

    Resample k draws Poisson(1) copies of each user from a generator seeded by
    the user's hash, so users never gather in one task: a partition adds up its
    weighted sums per resample and only these meet.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((samples, 2))
        for f in frames:
            for h, v in zip(f["h"].to_numpy(), f["v"].to_numpy(float), strict=True):
                w = np.random.default_rng([seed, int(h) & (2**63 - 1)]).poisson(1.0, samples)
                total[:, 0] += w * v
                total[:, 1] += w
        yield pd.DataFrame({"k": np.arange(samples), "s": total[:, 0], "w": total[:, 1]})

    rows = per_user.select(F.xxhash64(user).alias("h"), F.col(metric).cast("double").alias("v")).where("v IS NOT NULL")
    means = rows.mapInPandas(sums, "k int, s double, w double").groupBy("k").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.agg(F.count(F.lit(1)).alias("users"), F.avg("v").alias("mean")).crossJoin(F.broadcast(interval)).select("users", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def rank_by_counting(scored: DataFrame, request: str, score: str, item: str, target: str, eligible: str | None = None) -> DataFrame:
    """(request, rank): 1 + the eligible entries ahead of each request's target.

    Ahead: a higher score, or an equal one with a smaller id.  Requests whose
    target is not among their eligible entries have no row.
    """
    rows = scored.where(F.col(eligible)) if eligible else scored
    of = Window.partitionBy(request)
    own = F.max(F.when(F.col(item) == F.col(target), F.col(score))).over(of)
    ahead = (F.col(score) > own) | ((F.col(score) == own) & (F.col(item) < F.col(target)))
    return rows.withColumn("__ahead", ahead.cast("int")).groupBy(request).agg((F.sum("__ahead") + 1).alias("rank")).where("rank IS NOT NULL")
