"""Alternating least squares on blocks of both sides.

Each side's rows are numbered within blocks once, and the ratings are laid out
by either side's blocks.  A half step's task solves a block, looking up the
other side's factors in mapped files: no factor is shuffled, and none is copied
to a rating but those of the rows being solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.arrays import open_arrays, save_arrays
from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace

#: Ratings of a block, and those whose factors are held at a time (a row's own at least).
BLOCK_RATINGS, HELD_RATINGS = 500_000, 40_000
_FILES = "block int, file string"


def ridge(q: np.ndarray, value: np.ndarray, reg: float) -> np.ndarray:
    """Ridge solutions of rows with equally many ratings: q (rows, n, k), value (rows, n)."""
    turned = q.swapaxes(1, 2)
    n, k = q.shape[1:]
    if n < k:  # (Q'Q + reg)^-1 Q' = Q' (QQ' + reg)^-1, the smaller system
        return (turned @ np.linalg.solve(q @ turned + reg * np.eye(n), value[:, :, None]))[:, :, 0]
    return np.linalg.solve(turned @ q + reg * np.eye(k), turned @ value[:, :, None])[:, :, 0]


def _looked_up(maps: dict[int, np.ndarray], block: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out, order = np.empty((len(at), k)), np.argsort(block, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
    for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[x:z]
        out[own] = maps[int(block[own[0]])][at[own]]
    return out


def _read(file: str, columns: list[str]) -> pa.Table:
    fs, inner = FileSystem.from_uri(file)
    with fs.open_input_file(inner) as source:
        return pq.ParquetFile(source).read(columns)


def _solved(folder: str, ratings: dict[int, str], factors: dict[int, str], own: str, other: str, k: int, reg: float):
    """(block, file) with the solutions of each block of the ``own`` side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                if b not in ratings:
                    continue
                maps = {o: open_arrays(f)["f"] for o, f in factors.items()}
                t = _read(ratings[b], [f"{own}_at", f"{other}_block", f"{other}_at", "value"])
                row, block, at, value = (t[c].to_numpy() for c in t.column_names)
                n = np.bincount(row)
                start, f = np.concatenate([[0], np.cumsum(n)[:-1]]), np.zeros((len(n), k))
                for size in np.unique(n).tolist():
                    alike, step = np.flatnonzero(n == size), max(1, HELD_RATINGS // size)
                    for x in range(0, len(alike), step):
                        rows = alike[x : x + step]
                        spot = start[rows][:, None] + np.arange(size)
                        q = _looked_up(maps, block[spot.ravel()], at[spot.ravel()], k)
                        f[rows] = ridge(q.reshape(len(rows), size, k), value[spot], reg)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([save_arrays(folder, {"f": f})])], names=["block", "file"])

    return run


def _saved(folder: str):
    """(block, file) of factor rows sorted by place, a block to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            f = np.concatenate([b.column("f").flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
            yield pa.RecordBatch.from_arrays([held[0].column("block")[:1], pa.array([save_arrays(folder, {"f": f})])], names=["block", "file"])

    return run


def _rows(files: dict[int, str], named: dict[int, str]):
    """(idx, f) of the factor files, whose rows stand as the ids do in their own files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                if b not in files:
                    continue
                f, ids = open_arrays(files[b])["f"], _read(named[b], ["idx"])["idx"].combine_chunks()
                for x in range(0, len(f), 10_000):
                    part = f[x : x + 10_000]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([ids[x : x + 10_000], flat], names=["idx", "f"])

    return run


def _files(laid: DataFrame, block: str) -> dict[int, str]:
    """The file of each block of a table that was laid out by ``block``."""
    return {r["b"]: r["f"] for r in laid.select(F.col(block).alias("b"), F.input_file_name().alias("f")).distinct().collect()}


@dataclass
class Placed:
    """Where factors are: by side, (idx, block, at) and the file of each block."""

    ids: dict[str, DataFrame]
    files: dict[str, dict[int, str]]
    k: int

    def predict(self, pairs: DataFrame, output: str) -> DataFrame:
        """``pairs`` with the product of their factors, 0 where a side is unknown.

        Only places are joined to the pairs; factors are looked up a batch at a time.
        """
        rows, sides = pairs, list(self.ids)
        for n, c in enumerate(sides):
            rows = rows.join(self.ids[c].select(F.col("idx").alias(c), F.col("block").alias(f"__block{n}"), F.col("at").alias(f"__at{n}")).hint("merge"), c, "left")
        kept = rows.drop(*(f"__{x}{n}" for x in ("block", "at") for n in (0, 1)), output)
        files, k, names = [self.files[c] for c in sides], self.k, [*kept.columns, output]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maps = None
            for batch in batches:
                if maps is None:
                    maps = [{b: open_arrays(f)["f"] for b, f in own.items()} for own in files]
                block, at = ([pc.fill_null(batch.column(f"__{x}{n}"), -1).to_numpy() for n in (0, 1)] for x in ("block", "at"))
                known, out = np.flatnonzero((block[0] >= 0) & (block[1] >= 0)), np.zeros(batch.num_rows)
                if len(known):
                    p, q = (_looked_up(maps[n], block[n][known], at[n][known], k) for n in (0, 1))
                    out[known] = np.einsum("ij,ij->i", p, q)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(out)], names=names)

        return rows.select(*kept.columns, "__block0", "__at0", "__block1", "__at1").mapInArrow(run, kept.withColumn(output, F.lit(0.0)).schema)


def als_in_blocks(triplets: DataFrame, user: str, item: str, start, k: int, reg: float, iterations: int, space: Workspace) -> tuple[DataFrame, DataFrame, Placed]:
    """(idx, f) of users and of items after ``iterations`` rounds, and their places.

    ``triplets``: (user, item, value), written; ``start`` gives ids their first
    item factors.  No row should have more ratings than a task can hold factors of.
    Ids are joined by merging, as a broadcast of those of a side fills the driver.
    """
    spark, triplets = triplets.sparkSession, triplets.where(F.col(user).isNotNull() & F.col(item).isNotNull())  # each id has a rating
    blocks = max(shuffle_width(spark), -(-triplets.count() // BLOCK_RATINGS))
    tasks, ids, named, placed = spark.range(0, blocks, 1, blocks), {}, {}, triplets
    for c in (user, item):
        own = triplets.select(F.col(c).alias("idx")).distinct().withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
        at = (F.row_number().over(Window.partitionBy("block").orderBy("idx")) - 1).cast("int")
        ids[c] = space.write(own.withColumn("at", at).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "at"), f"ids_{c}")
        named[c] = _files(ids[c], "block")
        placed = placed.join(ids[c].select(F.col("idx").alias(c), F.col("block").alias(f"{c}_block"), F.col("at").alias(f"{c}_at")).hint("merge"), c)
    placed = space.write(placed.drop(user, item), "placed")
    ratings: dict[str, dict[int, str]] = {}
    for c in (user, item):
        laid = space.write(placed.repartitionById(blocks, F.col(f"{c}_block")).sortWithinPartitions(f"{c}_block", f"{c}_at"), f"by_{c}")
        ratings[c] = _files(laid, f"{c}_block")
    space.drop("placed")
    first = start(ids[item]).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "at").select("block", "f")
    files = {item: {r["block"]: r["file"] for r in first.mapInArrow(_saved(space.path(f"{item}-1")), _FILES).collect()}}
    for t in range(iterations):
        for c, o in ((user, item), (item, user)):
            space.drop(f"{c}{t - 1}")  # its own last ones are not read
            run = _solved(space.path(f"{c}{t}"), ratings[c], files[o], c, o, k, reg)
            files[c] = {r["block"]: r["file"] for r in tasks.mapInArrow(run, _FILES).collect()}
    space.drop(f"by_{user}")
    space.drop(f"by_{item}")
    # Without a join: Spark takes what tasks map from a few block numbers for small and would broadcast the factors.
    found = (tasks.mapInArrow(_rows(files[c], named[c]), f"idx {dict(triplets.dtypes)[c]}, f array<double>") for c in (user, item))
    users, items = (space.write(f, name) for f, name in zip(found, ("users", "items"), strict=True))
    return users, items, Placed(ids, files, k)
