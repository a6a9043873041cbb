"""Exact retrieval over vectors: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace

#: Queries of a block: what each task holds beside a batch of rows.
QUERY_BLOCK = 2048


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _prepared(v: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return v
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


class _Asked:
    """A block of queries and the k best rows of each so far."""

    def __init__(self, t: pa.Table, k: int, metric: str, exclude_self: bool) -> None:
        self.ids, self.k, self.metric, self.exclude_self = t["key"].to_numpy(), k, metric, exclude_self
        self.v = _prepared(_matrix(t["v"]), metric)
        self.group = np.array(t["grp"].to_pylist(), object) if "grp" in t.column_names else None
        self.time = t["at"].to_numpy() if "at" in t.column_names else None
        self.row, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, self.ids.dtype), np.zeros(0)
        self.floor = np.full(len(self.ids), -np.inf)  # the k-th best so far

    def meet(self, b: pa.RecordBatch) -> None:
        own, v, q = b.column("key").to_numpy(zero_copy_only=False), _prepared(_matrix(b.column("v")), self.metric), self.v
        score = q @ v.T if self.metric != "euclidean" else -np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ v.T + (v**2).sum(1)))
        score = np.round(score, 9)
        if self.exclude_self:
            score[self.ids[:, None] == own] = -np.inf
        if self.group is not None:
            score[self.group[:, None] != np.array(b.column("grp").to_pylist(), object)] = -np.inf
        if self.time is not None:
            score[~(b.column("at").to_numpy(zero_copy_only=False)[None, :] <= self.time[:, None])] = -np.inf
        if score.shape[1] > self.k:  # the k best of the batch, and what equals the last of them
            self.floor = np.maximum(self.floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        x, y = np.nonzero((score >= self.floor[:, None]) & np.isfinite(score))
        row, near, score = (np.concatenate(c) for c in ((self.row, x), (self.near, own[y]), (self.score, score[x, y])))
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = score[last]
        best = place < self.k
        self.row, self.near, self.score = row[best], near[best], score[best]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.near), pa.array(self.score)], names=["query", "neighbor", "score"])


def _scan(k: int, metric: str, exclude_self: bool):
    """The best of (asked, rows) pairs of files, a block of queries at a time."""

    def table(path: str):
        fs, inner = FileSystem.from_uri(path)
        return pq.ParquetFile(inner, filesystem=fs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, rows in zip(b.column("asked").to_pylist(), b.column("rows").to_pylist(), strict=True):
                queries = table(asked)
                for g in range(queries.num_row_groups):
                    block = queries.read_row_group(g)
                    for at in range(0, len(block), QUERY_BLOCK):
                        best = _Asked(block.slice(at, QUERY_BLOCK).combine_chunks(), k, metric, exclude_self)
                        for held in table(rows).iter_batches(batch_size=4096):
                            best.meet(held)
                        yield best.batch()

    return run


def exact_top_k(
    queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", key: str = "idx", vector: str = "v", group: str | None = None,
    time: str | None = None, eligible: str | None = None, exclude_self: bool = True,
) -> DataFrame:
    """(query, neighbor, score, rank): the k best rows of each query, ties by id.

    ``metric``: cosine, dot or euclidean (score is minus the distance).
    ``group``: only rows of the query's group.  ``time``/``eligible``: only rows
    whose ``eligible`` value is at most the query's ``time``.  Null vectors and
    null ids take no part.  Scores are compared after rounding to 9 decimals.

    Both sides are written once in parts; a task meets one part of the queries
    with one part of the rows by blocks of matrix products and keeps the k best
    of each query, and only those meet in the final window.  Neither side is
    broadcast, collected or held whole.
    """
    space, spark = Workspace(rows.sparkSession, "exact"), rows.sparkSession
    kinds = {key: dict(rows.dtypes)[key]}

    def written(df: DataFrame, at: str | None, name: str) -> list[str]:
        columns = [F.col(key).alias("key"), F.col(vector).alias("v"), *([F.col(group).alias("grp")] if group else []), *([F.col(at).alias("at")] if at else [])]
        usable = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*columns)
        return space.write(usable, name, **{"parquet.block.row.count.limit": 8 * QUERY_BLOCK}).inputFiles()

    asked, held = written(queries, time, "asked"), written(rows, eligible, "rows")
    # Every part of the queries with every part of the rows: a list of names.
    tasks = spark.createDataFrame([(f, sorted(held)) for f in sorted(asked)], "asked string, rows array<string>").select("asked", F.explode("rows").alias("rows"))
    tasks = tasks.repartition(max(1, min(len(asked) * len(held), 4 * shuffle_width(spark))), "asked", "rows")
    met = tasks.mapInArrow(_scan(k, metric, exclude_self), f"query {kinds[key]}, neighbor {kinds[key]}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbor"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def padded_lists(ranked: DataFrame, queries: DataFrame, key: str, k: int, missing: int = -1) -> DataFrame:
    """(query, neighbors): k ids in rank order, ``missing`` where there are fewer."""
    lists = ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))), lambda x: x["neighbor"]).alias("l"))
    rows = queries.select(F.col(key).alias("query")).distinct().join(lists, "query", "left")
    own = F.coalesce("l", F.array().cast(dict(lists.dtypes)["l"]))
    return rows.select("query", F.concat(own, F.array_repeat(F.lit(missing).cast("long"), F.lit(k) - F.size(own))).alias("neighbors"))


def list_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: mean share of a's lists that b's lists hold."""
    hit = a.select("query", "neighbor").join(b.select("query", "neighbor"), ["query", "neighbor"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    sizes = a.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(hit, "query", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("size")).alias("overlap"))


def intra_list_diversity(lists: DataFrame, rows: DataFrame, key: str = "idx", vector: str = "v") -> DataFrame:
    """(query, diversity): 1 - mean cosine of a list's pairs; 0 below two items.

    The pair sum follows from the sum of the list's unit vectors, so no pairs
    are formed.
    """
    unit = rows.select(F.col(key).alias("neighbor"), F.col(vector).alias("v"))
    dim = rows.select(F.max(F.size(vector)).alias("d")).first()["d"] or 0
    from kelpwright.functions.scalars import norm

    long = lists.select("query", "neighbor").join(unit, "neighbor").withColumn("s", norm("v"))
    scaled = [F.sum(F.col("v")[j].cast("double") / F.col("s")) for j in range(dim)]
    square = sum((s * s for s in scaled), F.lit(0.0))
    n = F.count(F.lit(1))
    return long.groupBy("query").agg(F.when(n < 2, 0.0).otherwise(1 - (square - n) / (n * (n - 1))).alias("diversity"))


def silhouette(rows: DataFrame, vector: str, label: str, key: str, limit: int = 2000) -> DataFrame:
    """One row: mean Euclidean silhouette over a hash sample of ``limit`` rows.

    The sample size is the operator's parameter; distances go to the sample,
    held by each task, and never to all rows.
    """
    from kelpwright.operators.encode import sample_rows

    sample = sample_rows(rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()), limit, key)
    held = sample.select(vector, label).collect()
    base = np.array([r[0] for r in held], np.float64).reshape(len(held), -1)
    names, of = np.unique([r[1] for r in held], return_inverse=True)
    size = np.bincount(of, minlength=len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own = _matrix(b.column(vector)), np.searchsorted(names, b.column(label).to_numpy(zero_copy_only=False))
            d = np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] - 2 * v @ base.T + (base**2).sum(1)))
            sums = np.stack([d[:, of == c].sum(1) for c in range(len(names))], 1)
            at = np.arange(len(v))
            inner = sums[at, own] / np.maximum(size[own] - 1, 1)
            mean = sums / size
            mean[at, own] = np.inf
            outer = mean.min(1)
            s = np.where(size[own] > 1, (outer - inner) / np.maximum(inner, outer), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    return sample.mapInArrow(run, "s double").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
