"""Readers with declared schemas."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwright.storage import open_stream

RATINGS = "user_id int, movie_id int, rating float, timestamp long"
MOVIES = "movie_id int, title string, genres string"


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "::", encoding: str = "UTF-8") -> DataFrame:
    """Headerless text with a separator of any length."""
    return spark.read.schema(schema).option("sep", separator).option("encoding", encoding).option("mode", "FAILFAST").csv(path)


def ratings_and_movies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return delimited(spark, f"{folder}/ratings.dat", RATINGS), delimited(spark, f"{folder}/movies.dat", MOVIES, encoding="ISO-8859-1")


def csv(spark: SparkSession, path: str | Sequence[str], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header; columns not asked for are pruned by the scan."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path if isinstance(path, str) else list(path))
    return rows.select(*columns) if columns else rows


def csv_with_row_number(spark: SparkSession, path: str, schema: str, request: str = "request_id") -> DataFrame:
    """CSV rows with ``request`` = file name:row number, rows counted from 0.

    Files are the unit of work, as a row's number depends on all before it; a
    file is streamed in chunks and never held whole.
    """
    struct = spark.createDataFrame([], schema).schema
    out = T.StructType([T.StructField(request, T.StringType()), *struct.fields])
    names = [f.name for f in struct.fields]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file in (f for frame in frames for f in frame["path"]):
            base, at = file.rsplit("/", 1)[-1], 0
            with open_stream(file) as stream:
                for chunk in pd.read_csv(stream, usecols=names, chunksize=50_000):
                    chunk.insert(0, request, [f"{base}:{at + k}" for k in range(len(chunk))])
                    at += len(chunk)
                    yield chunk[[request, *names]]

    return _files(spark, path).mapInPandas(parse, out)


class _Member(io.RawIOBase):
    """A member of a streamed archive: read once, from start to end."""

    def __init__(self, member: object) -> None:
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: bytearray) -> int:
        part = self.member.read(len(buffer))
        buffer[: len(part)] = part
        return len(part)


def csv_in_tar(spark: SparkSession, path: str, schema: str, member: str) -> DataFrame:
    """Rows of the archive's CSV members whose name contains ``member``.

    An archive, plain or compressed, is streamed member by member.
    """
    struct = spark.createDataFrame([], schema).schema
    names = [f.name for f in struct.fields]
    out = T.StructType([T.StructField("member", T.StringType()), *struct.fields])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file in (f for frame in frames for f in frame["path"]):
            with open_stream(file) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                for info in tar:
                    if info.isfile() and member in info.name:
                        for chunk in pd.read_csv(io.BufferedReader(_Member(tar.extractfile(info))), usecols=names, chunksize=50_000):
                            chunk.insert(0, "member", info.name)
                            yield chunk[["member", *names]]

    return _files(spark, path).mapInPandas(parse, out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files' paths; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or plain; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Projection and predicate reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def in_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` over Arrow batches of spark.sql.execution.arrow.maxRecordsPerBatch rows."""
    return df.mapInArrow(lambda batches: map(f, batches), schema)


def matrix_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_idx int, item_idx int, value double").parquet(path)


def run_manifests(spark: SparkSession, root: str, name: str = "run_manifest.json") -> DataFrame:
    """All manifests below ``root`` with ``run``, the folder they lie in."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"))


def metric_log(spark: SparkSession, path: str, schema: str, metric: str, step: str) -> DataFrame:
    """One row: best and last value of a metric in a JSON-lines log."""
    rows = spark.read.schema(schema).json(path).where(F.col(metric).isNotNull())
    return rows.agg(F.max(metric).alias("best"), F.max_by(metric, step).alias("last"), F.max(step).alias("steps"))


def embedded_json(df: DataFrame, text: str, schema: str, output: str = "data") -> DataFrame:
    """The one fenced JSON block of each text, parsed; null unless there is just one."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```json\s*\n(.*?)\n```"), 1)
    return df.withColumn(output, F.from_json(F.when(F.size(blocks) == 1, blocks[0]), schema))
