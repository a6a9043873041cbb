"""Choosing among runs: argmin and argmax, ties, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, order: Sequence[Column], per: Sequence[str] = ()) -> DataFrame:
    """The first row in ``order``, overall or of each group."""
    if not per:
        return df.orderBy(*order).limit(1)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where("__r = 1").drop("__r")


def best_with_ties(df: DataFrame, per: Sequence[str], value: str, higher: bool = True) -> DataFrame:
    order = F.desc(value) if higher else F.asc(value)
    return df.where(F.col(value).isNotNull()).withColumn("__r", F.rank().over(Window.partitionBy(*per).orderBy(order))).where("__r = 1").drop("__r")


def early_stopping(df: DataFrame, run: str, epoch: str, scores: Sequence[str], patience: int) -> DataFrame:
    """Each epoch with ``best_epoch``, ``waited`` and ``stopped``.

    An epoch is best if its scores, compared in turn, exceed all before it; a
    run stops once ``patience`` epochs in a row were not.
    """
    score = F.struct(*scores)
    upto = Window.partitionBy(run).orderBy(epoch)
    past = F.max(score).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    better = past.isNull() | (score > past)
    rows = df.withColumn("__best", F.when(better, F.col(epoch)))
    rows = rows.withColumn("best_epoch", F.max("__best").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    waited = F.row_number().over(Window.partitionBy(run, "best_epoch").orderBy(epoch)) - 1
    rows = rows.withColumn("waited", waited)
    stopped = F.max((F.col("waited") >= patience).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    return rows.withColumn("stopped", stopped).drop("__best")


def nearest_to_quantiles(df: DataFrame, key: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """(quantile, key, value): the row nearest each quantile, none chosen twice."""
    targets = df.agg(F.percentile(value, F.array(*map(F.lit, quantiles))).alias("q")).first()["q"]
    picked: list = []
    for q, t in zip(quantiles, targets or [], strict=False):
        row = df.where(~F.col(key).isin([p[1] for p in picked])).orderBy(F.abs(F.col(value) - t), key).first()
        if row is not None:
            picked.append((q, row[key], row[value]))
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame(picked, f"quantile double, {key} {kinds[key]}, {value} {kinds[value]}")


def weighted_mean(df: DataFrame, value: str, weight: str, per: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*per).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))
