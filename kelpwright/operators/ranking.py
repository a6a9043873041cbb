"""Global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace


def global_index(df: DataFrame, order: Sequence[Column], output: str = "idx") -> DataFrame:
    """``df`` with ``output``: each row's 0-based place in ``order``.

    ``order`` should be total.  Rows are range partitioned and written once;
    places are counted within a partition and offset by the sizes of those
    before it, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), *order).withColumn("__part", F.spark_partition_id())
    rows = Workspace(spark, "index").write(ranged, "ranged")
    sizes = rows.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.join(offsets, "__part").withColumn(output, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def seeded_order(*ids: str, seed: int = 42) -> Column:
    """A reproducible shuffle: the digest of the seed and the ids as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def average_percentile(value: Column, total: Column, ties: Column) -> Column:
    """Average-method descending percentile rank from a min rank and tie count."""
    return (value + (ties - 1) / 2) / total


def equal_count_bucket(place: Column, n: Column, k: int) -> Column:
    """1-based quantile bucket of the 1-based ``place`` among ``n``.

    Edges are linear quantiles of the places, so this differs from ntile.
    """
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((place - 1) * F.lit(k) / (n - 1)))).cast("int")
