"""Session construction and the two settings every operator relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own session.

    Time zone is pinned to UTC because epoch columns are cast to timestamps,
    AQE is on so that partition counts and skewed joins are settled at run time.
    """
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": os.environ.get("KELPWRIGHT_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kelpwright")
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(spark: SparkSession, at_least: int = 1) -> int:
    """Partition count for the explicit exchanges of Python-backed operators."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
