"""Top N items of every group by statistics-guided skipping.

Rows are clustered into files by (group, descending score), so the row groups
of a file carry narrow ranges of groups and, for a large group, of scores.
Row groups are then read in descending order of their maximum score, and those
strictly below the current N-th score of every group they hold are skipped by
their statistics alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace

#: Rows of a row group: the unit of skipping.
ROW_GROUP_ROWS = 20_000


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(inner, filesystem=fs)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the row groups of each file: what is in them, at best."""
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            meta = _open(path).metadata
            place = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)} if meta.num_row_groups else {}
            for k in range(meta.num_row_groups):
                group = meta.row_group(k).column(place["g"]).statistics
                score = meta.row_group(k).column(place["score"]).statistics
                lo, hi = (str(group.min), str(group.max)) if group is not None and group.has_min_max else (None, None)
                top = float(score.max) if score is not None and score.has_min_max else float("inf")
                rows.append((path, k, lo, hi, top))
        if rows:
            cols = list(zip(*rows, strict=True))
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "row_group", "lo", "hi", "top"])


def _best(rows: pa.Table, n: int, order: Sequence[tuple[str, str]]) -> pa.Table:
    """The first n distinct items of each group in the given order."""
    rows = rows.combine_chunks().take(pc.sort_indices(rows, sort_keys=[("g", "ascending"), *order]))
    code = lambda name: pc.dictionary_encode(rows[name].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    g = code("g")
    _, once = np.unique((g << 32) | code("item"), return_index=True)
    once.sort()
    g = g[once]
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    at = np.arange(len(g))
    return rows.take(pa.array(once[at - np.maximum.accumulate(np.where(fresh, at, 0)) < n]))


def _reader(n: int, order: Sequence[tuple[str, str]], schema: pa.Schema):
    def read(listing: pa.Table) -> pa.Table:
        files: dict = {}  # opened when first read, so a skipped file costs nothing

        def content(d: dict, **kw: list[str]) -> pa.Table:
            if d["path"] not in files:
                files[d["path"]] = _open(d["path"])
            return files[d["path"]].read_row_group(d["row_group"], **kw)

        parts: list[pa.Table] = []
        floor: dict[str, float] = {}  # N-th score by group, once it has N items
        for d in listing.sort_by([("top", "descending"), ("path", "ascending"), ("row_group", "ascending")]).to_pylist():
            if d["lo"] in floor and d["hi"] in floor and d["top"] < min(floor[d["lo"]], floor[d["hi"]]):
                held = {d["lo"]}
                if d["lo"] != d["hi"]:
                    held = set(map(str, content(d, columns=["g"])["g"].unique().to_pylist()))
                if all(d["top"] < floor.get(g, float("-inf")) for g in held):
                    continue
            rows = content(d).select(schema.names).cast(schema)
            if d["lo"] is not None and d["lo"] == d["hi"] and parts:
                rows = pa.concat_tables([*parts, rows])
                parts = []
            part = _best(rows, n, order)
            parts.append(part)
            sizes = part.group_by("g").aggregate([("score", "count"), ("score", "min")])
            for g, size, least in zip(*(sizes[c].to_pylist() for c in ("g", "score_count", "score_min")), strict=True):
                if size >= n:
                    floor[str(g)] = max(least, floor.get(str(g), float("-inf")))
        return _best(pa.concat_tables(parts), n, order) if parts else schema.empty_table()

    return read


def _sortable(c: Column) -> tuple[Column, Column]:
    """A double as (class, value) so that descending gives NaN, values, null."""
    kind = F.when(c.isNull(), 0).when(F.isnan(c), 2).otherwise(1)
    return kind, F.when(kind == 1, c + F.lit(0.0)).otherwise(F.lit(0.0))


def top_n_per_group(
    df: DataFrame, group: str, score: str, item: str, ties: Sequence[str] = (), n: int = 10, row_group_rows: int = ROW_GROUP_ROWS
) -> DataFrame:
    """The n best distinct items of each group: group, pos, item.

    Rows are ordered by ``score``, then each of ``ties``, descending (null last,
    NaN first), then ``item`` ascending; an item counts by its first row, so
    repeated rows and older scores change nothing.  Rows with a null group or
    item, or whose score is null, NaN or infinite, are left out.  An empty table
    gives no rows; other columns are ignored.

    A group of any size is spread over files by score.  The row groups that hold
    it alone form one task, which reads only those that can still matter; every
    other task reads one file.  Each hands on at most n rows a group.
    """
    spark = df.sparkSession
    value = F.col(score).cast("double")
    keys = [("score", "descending")]
    columns = [F.col(group).alias("g"), F.col(item).alias("item"), (value + F.lit(0.0)).alias("score")]
    for k, tie in enumerate(ties):
        kind, number = _sortable(F.col(tie).cast("double"))
        columns += [kind.cast("int").alias(f"c{k}"), number.alias(f"v{k}")]
        keys += [(f"c{k}", "descending"), (f"v{k}", "descending")]
    keys.append(("item", "ascending"))
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & (F.abs(value) < float("inf")) & ~F.isnan(value)).select(*columns)

    order = [F.col(c).desc() if way == "descending" else F.col(c).asc() for c, way in keys]
    space = Workspace(spark, "topn")
    clustered = rows.repartitionByRange(shuffle_width(spark), "g", *order).sortWithinPartitions("g", *order)
    table = space.write(clustered, "clustered", **{"parquet.block.row.count.limit": row_group_rows})
    paths = table.inputFiles()
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").repartition(min(len(paths), shuffle_width(spark)) or 1)
    listing = listing.mapInArrow(_describe, "path string, row_group int, lo string, hi string, top double")
    alone = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))
    listing = listing.withColumn("task", F.when(alone, F.concat(F.lit("group "), "lo")).otherwise(F.concat(F.lit("file "), "path")))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(f.name, f.dataType, False) for f in rows.schema])
    read = _reader(n, keys, pa.schema([(f.name, f.type) for f in to_arrow_schema(schema)]))
    # At most n rows a group and task; the clustered copy is not needed after them.
    best = space.write(listing.groupBy("task").applyInArrow(read, schema), "best")
    space.drop("clustered")
    best = best.repartition("g")
    first = F.row_number().over(Window.partitionBy("g", "item").orderBy(*order))
    pos = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    return (
        best.withColumn("nth", first).where("nth = 1")
        .withColumn("pos", pos).where(F.col("pos") <= n)
        .select(F.col("g").alias(group), "pos", F.col("item").alias(item))
    )
