"""Per-key counts where a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace


def heavy_keys(df: DataFrame, key: str, share: float = 0.001, rate: float | None = None, sample_rows: int = 200_000) -> DataFrame:
    """Keys that hold at least ``share`` of a random sample: column ``key``.

    At most 1/share keys can qualify, so the result has a proven bound and may
    be broadcast.  Sampling decides only how a key is processed, never what is
    counted, so a missed heavy key costs time and not correctness.  The list is
    read from a table, so that every use of it sees the same keys.
    """
    if rate is None:
        n = df.count()
        rate = min(1.0, sample_rows / max(1, n))
    sample = df.select(key)
    if rate < 1.0:
        sample = sample.sample(fraction=rate, seed=7)
    counts = sample.where(F.col(key).isNotNull()).groupBy(key).count()
    # No more rows than the sample, whose size is bounded, meet in this window.
    total = F.sum("count").over(Window.partitionBy())
    heavy = counts.withColumn("total", total).where(F.col("count") >= F.col("total") * share).select(key)
    return Workspace(df.sparkSession, "heavy").write(heavy, "keys")


def counts_per_key(df: DataFrame, key: str, record: str | None, user: str, share: float | None = None, sample_rows: int | None = None) -> DataFrame:
    """Per non-null ``key``: n_records and n_users.

    ``record``: column whose distinct non-null values are the records, or None
    where every row is one.  n_users counts distinct non-null users.  Rows of
    heavy keys are routed by a broadcast of the (bounded) heavy-key list and
    pre-aggregated on (key, record) and (key, user), which spreads one key over
    all tasks; the remaining keys take one shuffle on the key, after which both
    distinct counts are local.  The two parts are united.  An empty table gives
    no rows; a key whose users are all null has n_users 0.

    Unless given, ``share`` is a fourth of a shuffle partition's part of the
    rows, at most a thousandth, so that what other keys hold fits a partition at
    every width; the sample has 200 rows for each such share.
    """
    share = share or min(0.001, 0.25 / shuffle_width(df.sparkSession))
    rows = df.select(F.col(key).alias("k"), F.col(user).alias("u"), *([F.col(record).alias("r")] if record else []))
    heavy = F.broadcast(heavy_keys(rows, "k", share, sample_rows=sample_rows or int(200 / share)).withColumn("heavy", F.lit(True)))
    flagged = rows.where("k IS NOT NULL").join(heavy, "k", "left")
    hot, cold = flagged.where("heavy").drop("heavy"), flagged.where("heavy IS NULL").drop("heavy")

    records = F.countDistinct("r") if record else F.count(F.lit(1))
    rest = cold.repartition("k").groupBy("k").agg(records.alias("n_records"), F.countDistinct("u").alias("n_users"))

    # Null records and users stay as a group that counts nothing, so that every
    # key comes out.
    one = lambda c: F.col(c).isNotNull().cast("int")
    none = F.lit(0)
    hot_users = hot.groupBy("k", "u").agg(none.alias("x")).select("k", none.alias("a"), one("u").alias("b"))
    if record:
        hot_records = hot.groupBy("k", "r").agg(none.alias("x")).select("k", one("r").alias("a"), none.alias("b"))
    else:
        hot_records = hot.groupBy("k").agg(F.count(F.lit(1)).alias("a")).select("k", "a", none.alias("b"))
    top = hot_records.unionByName(hot_users).groupBy("k").agg(F.sum("a").alias("n_records"), F.sum("b").alias("n_users"))
    return rest.unionByName(top).withColumnRenamed("k", key)
