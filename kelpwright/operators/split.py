"""Temporal splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_user_split(df: DataFrame, order: Sequence[str], train: float = 0.8, validation: float = 0.1, user: str = "user_id") -> DataFrame:
    """``split`` by each user's order: the earliest rows train, the latest test.

    Every user has at least one row in each part; users with fewer than three
    rows are left out.
    """
    ordered = Window.partitionBy(user).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    rows = df.withColumns({"__at": F.row_number().over(ordered) - 1, "__n": n}).where("__n >= 3")
    end = F.least(F.greatest(F.floor(F.col("__n") * F.lit(train)), F.lit(1)), F.col("__n") - 2)
    rows = rows.withColumn("__a", end)
    rows = rows.withColumn("__b", F.least(F.greatest(F.floor(F.col("__n") * F.lit(train + validation)), F.col("__a") + 1), F.col("__n") - 1))
    part = F.when(F.col("__at") < F.col("__a"), "train").when(F.col("__at") < F.col("__b"), "validation").otherwise("test")
    return rows.withColumn("split", part).drop("__at", "__n", "__a", "__b")


def explicit_boundary_split(df: DataFrame, order: Sequence[str], train: float = 0.8, validation: float = 0.1, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Split where the cuts count rated rows only.

    An unrated row goes to the part of the next rated row.  Validation and test
    rows of items that train does not have are dropped, as are users with fewer
    than three rated rows.
    """
    rated = (F.col("rating") > 0).cast("int")
    before = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({"__e": F.coalesce(F.sum(rated).over(before), F.lit(0)), "__n": F.sum(rated).over(Window.partitionBy(user))}).where("__n >= 3")
    rows = rows.withColumn("__a", F.least(F.greatest(F.floor(F.col("__n") * F.lit(train)), F.lit(1)), F.col("__n") - 2))
    rows = rows.withColumn("__b", F.least(F.greatest(F.floor(F.col("__n") * F.lit(train + validation)), F.col("__a") + 1), F.col("__n") - 1))
    part = F.when(F.col("__e") < F.col("__a"), "train").when(F.col("__e") < F.col("__b"), "validation").otherwise("test")
    rows = rows.withColumn("split", part).drop("__e", "__n", "__a", "__b")
    warm = rows.where("split = 'train'").select(item).distinct()
    later = rows.where("split != 'train'").join(warm, item, "left_semi").select(*rows.columns)
    return rows.where("split = 'train'").unionByName(later)


def time_window_split(df: DataFrame, cuts: Sequence[tuple[str, int]], last: str, time: str, random: str | None = None) -> DataFrame:
    """``split`` by half-open windows: (name, end) pairs, then ``last``.

    Rows flagged by ``random`` are their own split; a null time has none.
    """
    part = F.when(F.col(random), "random") if random else F.when(F.lit(False), "")
    part = part.when(F.col(time).isNull(), F.lit(None))
    for name, end in cuts:
        part = part.when(F.col(time) < end, name)
    return df.withColumn("split", part.otherwise(last))
