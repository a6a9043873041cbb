"""Sinks, manifests and their verification."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwright.storage import open_stream


def write_parquet(df: DataFrame, path: str, row_group_rows: int = 32_768, partition_by: str | None = None) -> None:
    """Overwrites: a rebuild leaves no stale rows."""
    writer = df.write.mode("overwrite").option("parquet.block.row.count.limit", row_group_rows)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def as_json_rows(df: DataFrame, output: str = "json") -> DataFrame:
    """Each row as JSON with its keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(output))


def write_json(df: DataFrame, path: str) -> None:
    as_json_rows(df, "value").write.mode("overwrite").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files below a folder, by relative path.

    Files are streamed, so their size does not matter.
    """
    import hashlib

    inner = f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for file in frame["path"]:
                with open_stream(file) as stream:
                    sha = hashlib.sha256()
                    while part := stream.read(1 << 20):
                        sha.update(part)
                found.append(sha.hexdigest())
            yield frame.assign(sha256=found)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("length").alias("bytes"))
    rows = rows.mapInPandas(digest, "path string, bytes bigint, sha256 string")
    return rows.select(F.element_at(F.split("path", re.escape(inner), 2), -1).alias("file"), "bytes", "sha256")


def verify_bundle(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, fault) of files that are missing, new or changed; none if intact."""
    now = checksums(spark, path).withColumnsRenamed({"bytes": "bytes_now", "sha256": "sha_now"})
    both = manifest.select("file", "bytes", "sha256").join(now, "file", "full")
    fault = (
        F.when(F.col("sha_now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("sha256") != F.col("sha_now")) | (F.col("bytes") != F.col("bytes_now")), "changed")
    )
    return both.select("file", fault.alias("fault")).where("fault IS NOT NULL")


def verify_file(content: bytes, sha256: str | None = None, md5: str | None = None) -> None:
    """Raise unless the content has the stated digests."""
    import hashlib

    for name, want in (("sha256", sha256), ("md5", md5)):
        if want is not None and hashlib.new(name, content).hexdigest() != want.lower():
            raise ValueError(f"{name} does not match")


def canonical(rows: Iterator[dict]) -> str:
    return json.dumps(list(rows), sort_keys=True, separators=(",", ":"))


def to_records(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """A bounded report table as plain records; more rows than the limit fail."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: a report is an aggregate")
    return [json.loads(pd.Series(r.asDict(True)).to_json()) for r in rows]
