"""Most similar vectors by multi-probe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into cells of equal
width; the cells of all of a table's functions are a vector's bucket there.  A
neighbour of cosine c projects about c times where the query does, with a
spread of sqrt(1 - c^2): this gives each bucket a chance of success, and a
query visits the likeliest ones of each table, in that order.  Candidates of
all tables are merged and ranked by the exact cosine.

The number of functions, the cell width and the number of buckets visited are
fitted: a bounded sample of queries is searched exactly against all vectors,
and the cheapest setting is taken that finds the wished share of what the
sample should find.  If no other does, it is one that visits every bucket.

A table is written sorted by bucket.  A task holds a block of queries, sorted
by bucket too, reads the row groups that its queries' buckets lie in, one at a
time, and keeps each query's best: no candidate pair is ever shuffled, a task's
memory is that of a block and a row group, and a crowded bucket is met by many
blocks of queries in many row groups.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace

#: Queries a task searches at a time, vectors of a row group, and the pairs of
#: a bucket that are compared at a time.
QUERY_BLOCK, ROW_GROUP, PAIRS = 16384, 8192, 4_000_000
#: Bounds of what the setting is fitted on: queries searched exactly, those of
#: them whose finds are compared, and vectors for the sizes of buckets.
SAMPLE_QUERIES, SAMPLE_FIT, SAMPLE_VECTORS = 1024, 128, 20_000
#: (functions, cell width) tried, and buckets visited in each table.
SETTINGS = ((4, 2.5), (6, 2.5), (8, 2.5), (8, 1.8), (10, 2.5), (10, 1.8), (12, 1.8))
VISITS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
TABLES = 2
#: Cells end here, in standard deviations; the outermost ones are open.
_REACH = 2.5
#: Nanoseconds of a comparison, a visit, a bucket of a block, and a table's row.
_PAIR_NS, _VISIT_NS, _BUCKET_NS, _ROW_NS = 4, 700, 60_000, 20_000
#: More than the error of a single-precision cosine and of rounding to 6 decimals.
_SLACK = 2e-6

_GRID = np.linspace(-8, 8, 4001)
_CDF = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


@dataclasses.dataclass(frozen=True)
class Setting:
    """What a search does: buckets, and how many of them each query visits."""

    functions: int
    width: float
    tables: int
    visits: int
    cosine: float
    recall: float = 1.0


class PStable:
    """One hash table of p-stable functions, the same on every executor."""

    def __init__(self, dim: int, table: int, functions: int, width: float) -> None:
        rng = np.random.default_rng([dim, table, functions])
        a = rng.normal(size=(dim, functions))
        if functions <= dim:  # Gaussian directions at right angles spread better
            a = np.linalg.qr(a)[0] * math.sqrt(dim)
        self.a, self.b, self.width = a, rng.random(functions) * width, width
        self.low = np.floor((self.b - _REACH) / width)
        self.count = (np.floor((self.b + _REACH) / width) - self.low + 1).astype(np.int64)

    def buckets(self, v: np.ndarray) -> np.ndarray:
        cells = np.floor((v @ self.a + self.b) / self.width) - self.low
        cells = np.clip(cells, 0, self.count - 1).astype(np.int64)
        code = np.zeros(len(v), np.int64)
        for j, n in enumerate(self.count.tolist()):
            code = code * n + cells[:, j]
        return code

    def visits(self, v: np.ndarray, n: int, cosine: float) -> np.ndarray:
        """The n buckets of each row where a neighbour of that cosine most likely is, likeliest first (-1: no more)."""
        at, spread = v @ self.a * cosine, math.sqrt(max(1e-4, 1 - cosine * cosine))
        chance, code = np.zeros((len(v), 1)), np.zeros((len(v), 1), np.int64)
        for j, cells in enumerate(self.count.tolist()):
            # The likeliest buckets extend the likeliest ones of fewer functions.
            edge = (self.low[j] + np.arange(1, cells)) * self.width - self.b[j]
            below = np.interp((edge - at[:, j, None]) / spread, _GRID, _CDF)
            p = np.diff(below, axis=1, prepend=0, append=1)
            chance = (chance[:, :, None] + np.log(np.maximum(p, 1e-30))[:, None, :]).reshape(len(v), -1)
            code = (code[:, :, None] * cells + np.arange(cells)).reshape(len(v), -1)
            if chance.shape[1] > n:
                best = np.argpartition(-chance, n - 1, axis=1)[:, :n]
                chance, code = np.take_along_axis(chance, best, 1), np.take_along_axis(code, best, 1)
        code = np.take_along_axis(code, np.argsort(-chance, axis=1, kind="stable"), 1)
        return np.pad(code, ((0, 0), (0, max(0, n - code.shape[1]))), constant_values=-1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _buckets(dim: int, setting: Setting) -> int:
    return math.prod(PStable(dim, 0, setting.functions, setting.width).count.tolist())


class _Best:
    """The k best of each query so far, by rounded cosine, then id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, least: float) -> None:
        self.ids, self.v, self.single, self.k, self.least = ids, v, v.astype(np.float32), k, least
        self.floor = np.full(len(ids), least - _SLACK, np.float32)
        self.open = np.ones(len(ids), bool)  # nothing seen yet
        self.row, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, single: np.ndarray) -> None:
        """Compare the queries ``rows`` with vectors of a bucket."""
        step = max(1, PAIRS // max(1, len(ids)))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            cos = self.single[own] @ single.T
            new = self.open[own]
            if new.any() and len(ids) > self.k + 1:
                # No k-th best can lie below that of any bucket; one may be the query itself.
                low = np.partition(cos[new], len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
                self.floor[own[new]] = np.maximum(self.floor[own[new]], low - np.float32(_SLACK))
                self.open[own[new]] = False
            x, y = np.nonzero(cos >= self.floor[own, None])
            x = own[x]
            other = self.ids[x] != ids[y]
            x, y = x[other], y[other]
            if not len(x):
                continue
            score = np.einsum("ij,ij->i", self.v[x], v[y])
            good = score >= self.least
            self.fresh.append((x[good], ids[y[good]], score[good]))
            self.size += int(good.sum())
            if self.size > 400_000:
                self.merge()

    def merge(self) -> None:
        parts = [(self.row, self.near, self.score), *self.fresh]
        row, near, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        rounded = np.round(score, 6)
        order = np.lexsort((near, -rounded, row))
        row, near, score, rounded = row[order], near[order], score[order], rounded[order]
        once = np.ones(len(row), bool)  # of several tables
        once[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
        row, near, score, rounded = row[once], near[once], score[once], rounded[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], (rounded[last] - _SLACK).astype(np.float32))
        self.open[row[last]] = False
        best = place < self.k
        self.row, self.near, self.score = row[best], near[best], score[best]
        self.fresh, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.near), pa.array(self.score)], names=["a", "m", "cosine"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of at most ``rows`` rows, but for the size of a batch."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        return t["idx"].to_numpy(), _matrix(t["v"])

    for b in batches:
        if held and size + b.num_rows > rows:
            yield out()
            held, size = [], 0
        held.append(b)
        size += b.num_rows
    if size:
        yield out()


def _index(dim: int, table: int, setting: Setting, bounds: np.ndarray):
    """(part, bucket, idx, v): parts are ranges of buckets of about equal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = PStable(dim, table, setting.functions, setting.width)
        for b in batches:
            ids = b.column("idx").to_numpy()
            bucket = hashed.buckets(_matrix(b.column("v"))) if b.num_rows else np.zeros(0, np.int64)
            # A bucket that spans several bounds is spread over their parts.
            low, high = np.searchsorted(bounds, bucket, "left"), np.searchsorted(bounds, bucket, "right")
            part = low + (ids * 2654435761 >> 7) % (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bucket), b.column("idx"), b.column("v")], names=["part", "bucket", "idx", "v"])

    return run


def _search(dim: int, files: list[list[str]], setting: Setting, k: int, least: float):
    """The best found of each query of (idx, v), which come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = [PStable(dim, t, setting.functions, setting.width) for t in range(len(files))]
        # Where which buckets are: footers are read once a task.
        where = []
        for t, paths in enumerate(files):
            for path in paths:
                fs, inner = FileSystem.from_uri(path)
                meta = pq.read_metadata(inner, filesystem=fs)
                for g in range(meta.num_row_groups):
                    stats = next(s for c in range(meta.num_columns) if (s := meta.row_group(g).column(c)).path_in_schema == "bucket").statistics
                    where.append((t, path, g, stats.min, stats.max))
        for ids, v in _blocks(batches, QUERY_BLOCK):
            best = _Best(ids, v, k, least)
            for t, table in enumerate(hashed):
                wanted = np.concatenate([table.visits(v[at : at + 1024], setting.visits, setting.cosine) for at in range(0, len(v), 1024)])
                row = np.repeat(np.arange(len(v)), wanted.shape[1])
                wanted = wanted.ravel()
                order = np.argsort(wanted, kind="stable")
                row, wanted = row[order], wanted[order]
                opened: dict[str, pq.ParquetFile] = {}
                for _, path, g, low, high in (w for w in where if w[0] == t):
                    a, z = np.searchsorted(wanted, low, "left"), np.searchsorted(wanted, high, "right")
                    if a == z:
                        continue
                    if path not in opened:
                        fs, inner = FileSystem.from_uri(path)
                        opened = {path: pq.ParquetFile(inner, filesystem=fs)}
                    held = opened[path].read_row_group(g, columns=["bucket", "idx", "v"])
                    bucket, held_ids, held_v = held["bucket"].to_numpy(), held["idx"].to_numpy(), _matrix(held["v"])
                    single = held_v.astype(np.float32)
                    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
                    own = bucket[cuts[:-1]]
                    begin, end = np.searchsorted(wanted, own, "left"), np.searchsorted(wanted, own, "right")
                    for i in np.flatnonzero(end > begin).tolist():
                        h = slice(cuts[i], cuts[i + 1])
                        best.meet(row[begin[i] : end[i]], held_ids[h], held_v[h], single[h])
            yield best.batch()

    return run


def _exact(ids: np.ndarray, v: np.ndarray, k: int, least: float):
    """The k best of the given queries among each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, v, k, least)
        for held_ids, held in _blocks(batches, 4096):
            best.meet(np.arange(len(ids)), held_ids, held, held.astype(np.float32))
        yield best.batch()

    return run


def fit_setting(dim: int, n: int, sample: np.ndarray, queries: np.ndarray, finds: np.ndarray, of: np.ndarray, cosine: np.ndarray, least: float, recall: float, block: int = QUERY_BLOCK) -> Setting:
    """The cheapest setting by which ``recall`` of the finds come out.

    ``sample``: vectors out of ``n``; ``queries``; ``finds[i]``: a vector that
    query ``of[i]`` should find, at ``cosine[i]``.
    """
    if not len(finds):
        return Setting(8, 1.8, TABLES, 16, float(np.clip(least, 0.5, 0.99)))
    usual = float(np.clip(np.median(cosine), 0.05, 0.99))
    error = math.sqrt(recall * (1 - recall) / len(queries))
    scale, best = n / max(1, len(sample)), None
    visits = np.array(VISITS)
    for functions, width in SETTINGS:
        hit, cost = np.zeros((len(finds), len(VISITS)), bool), np.zeros(len(VISITS))
        for t in range(TABLES):
            table = PStable(dim, t, functions, width)
            wanted = table.visits(queries, VISITS[-1], usual)
            buckets, counts = np.unique(table.buckets(sample), return_counts=True)
            at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            sizes = np.cumsum(np.where(buckets[at] == wanted, counts[at], 0), 1).mean(0) * scale
            same = wanted[of] == table.buckets(finds)[:, None]
            hit |= np.where(same.any(1), same.argmax(1), VISITS[-1])[:, None] < visits
            some = min(n, len(buckets) * min(4.0, scale))
            cost += _ROW_NS + visits * _VISIT_NS + np.minimum(some, visits * block) * _BUCKET_NS / block + sizes[visits - 1] * _PAIR_NS
        found = hit.mean(0)
        enough = np.flatnonzero(found >= min(recall + error, 1.0))
        if len(enough) and (best is None or cost[enough[0]] < best[0]):
            best = (cost[enough[0]], Setting(functions, width, TABLES, VISITS[enough[0]], usual, float(found[enough[0]])))
    # Else every bucket of one table: all pairs.
    return best[1] if best else Setting(4, 2.5, 1, 4**4, usual)


def usable_vectors(df: DataFrame, idx: str, vector: str) -> tuple[DataFrame, int]:
    """(idx, v) of the vectors that take part, one a row id, and their length.

    Left out: null ids, null or empty vectors, vectors with a null, NaN or
    infinite element, zero vectors, and vectors of another length than most.
    Of an id with several vectors the smallest counts; repeated rows count once.
    """
    rows = df.select(F.col(idx).cast("bigint").alias("idx"), F.col(vector).alias("v")).where("idx IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    dim = usual["s"] if usual else 0
    return rows.where(F.size("v") == dim).groupBy("idx").agg(F.min("v").alias("v")), dim


def _portion(df: DataFrame, of: int, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` of the ``of`` rows, by a hash of their id."""
    share = F.shiftrightunsigned(F.xxhash64("idx", F.lit(seed)), 11) / F.lit(float(2**53))
    return df.where(share < min(1.0, wanted / max(1, of)))


def _vectors(rows: list, dim: int) -> np.ndarray:
    return _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, dim))


def _fit(rows: DataFrame, n: int, sample: np.ndarray, asked: DataFrame, k: int, least: float, recall: float) -> Setting:
    dim = sample.shape[1]
    some = sorted(_portion(asked, asked.count(), SAMPLE_QUERIES, 2).select("idx", "v").collect(), key=lambda r: r["idx"])
    ids, v = np.array([r["idx"] for r in some], np.int64), _vectors(some, dim)
    near = rows.mapInArrow(_exact(ids, v, k, least), "a bigint, m bigint, cosine double")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "m"))
    near = near.withColumn("r", best).where(F.col("r") <= k).drop("r").withColumnRenamed("m", "idx")
    # At most k a query of the sample.
    got = sorted(rows.join(F.broadcast(near), "idx").select("a", "idx", "cosine", "v").collect(), key=lambda r: (r["a"], r["idx"]))
    finding = np.unique(np.array([r["a"] for r in got], np.int64))[:SAMPLE_FIT]
    got = [r for r in got if len(finding) and r["a"] <= finding[-1]]
    of = np.searchsorted(finding, np.array([r["a"] for r in got], np.int64))
    return fit_setting(dim, n, sample, v[np.isin(ids, finding)], _vectors(got, dim), of, np.array([r["cosine"] for r in got]), least, recall)


def most_similar(
    df: DataFrame, idx: str, vector: str, k: int = 10, min_cosine: float = -1.0, queries: DataFrame | None = None, recall: float = 0.95, setting: Setting | None = None
) -> DataFrame:
    """(idx, neighbor_idx, cosine): the k most similar others of each vector.

    By cosine rounded to 6 decimals, then the smaller neighbor_idx; pairs below
    ``min_cosine`` are left out.  ``queries`` (a column named as ``idx``) limits
    whose neighbours are wanted, never who may be one.  See usable_vectors for
    what takes part.

    Approximate: ``recall`` is the share of true finds that the fitted setting
    brings on the sample, with or without a ``min_cosine``; a ``setting`` given
    is taken as it is.  How the work is cut into tasks and blocks changes no
    result.  Equal vectors are searched once and expanded, at most k + 1 of them
    as neighbours.
    """
    spark = df.sparkSession
    space = Workspace(spark, "similar")
    clean, dim = usable_vectors(df, idx, vector)
    if not dim:
        return clean.select("idx", F.col("idx").alias("neighbor_idx"), F.lit(0.0).alias("cosine"))
    clean = space.write(clean, "clean")
    hashed = clean.select("idx", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    equal = hashed.groupBy("h1", "h2").agg(F.min("idx").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = space.write(hashed.join(equal, ["h1", "h2"]).select("rep", "idx"), "members")
    unique = clean.join(members.where("idx != rep").select("idx"), "idx", "left_anti").select("idx", "v")
    asked = wanted = None
    if queries is not None:
        wanted = space.write(queries.select(F.col(idx).cast("bigint").alias("own")).where("own IS NOT NULL").distinct(), "wanted")
        asked = wanted.join(members.withColumnRenamed("idx", "own"), "own", "left").select(F.coalesce("rep", "own").alias("idx")).distinct()
    seeking = lambda rows: rows if asked is None else rows.join(asked, "idx", "left_semi")

    n, parts = clean.count(), shuffle_width(spark)
    sample = _vectors(_portion(clean, n, SAMPLE_VECTORS, 1).select("v").collect(), dim)
    if setting is None:
        setting = _fit(unique, n, sample, seeking(unique), k, min_cosine, recall)
    tables: list[DataFrame] = []
    kind = clean.schema["v"].dataType.simpleString()
    for t in range(setting.tables):
        bounds = np.sort(PStable(dim, t, setting.functions, setting.width).buckets(sample))[np.arange(1, parts) * len(sample) // parts] if len(sample) else np.zeros(0, np.int64)
        rows = (tables[0].select("idx", "v") if tables else unique).mapInArrow(_index(dim, t, setting, bounds), f"part bigint, bucket bigint, idx bigint, v {kind}")
        rows = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("bucket", "idx").drop("part")
        tables.append(space.write(rows, f"table{t}", **{"parquet.block.row.count.limit": ROW_GROUP}))
    asking = tables[0]
    if asked is not None:
        asking = asking.join(asked, "idx", "left_semi").repartition(4 * parts, F.expr(f"bucket div {max(1, _buckets(dim, setting) // (4 * parts))}")).sortWithinPartitions("bucket")
    files = [sorted(t.inputFiles()) for t in tables]
    near = asking.select("idx", "v").mapInArrow(_search(dim, files, setting, k, min_cosine), "a bigint, m bigint, cosine double")
    near = space.write(near, "near")
    for name in ("clean", *(f"table{t}" for t in range(setting.tables))):
        space.drop(name)

    entry = F.struct((-F.round("cosine", 6)).alias("o"), "m", "cosine")
    # A class of equal vectors stands in as its k + 1 smallest ids, in its own list too.
    by_id = Window.partitionBy("rep").orderBy("idx")
    few = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).drop("r")
    near = near.join(few.select(F.col("rep").alias("m"), F.col("idx").alias("alike")), "m", "left").select("a", F.coalesce("alike", "m").alias("m"), "cosine")
    near = near.unionByName(few.select(F.col("rep").alias("a"), F.col("idx").alias("m"), F.lit(1.0).alias("cosine")))
    lists = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("near"))
    lists = lists.join(members.select(F.col("rep").alias("a"), F.col("idx").alias("own")), "a", "left").withColumn("own", F.coalesce("own", "a"))
    if wanted is not None:
        lists = lists.join(wanted, "own", "left_semi")
    others = F.slice(F.filter("near", lambda x: x["m"] != F.col("own")), 1, k)
    return lists.select(F.col("own").alias("idx"), F.explode(others).alias("n")).select("idx", F.col("n.m").alias("neighbor_idx"), "n.cosine")
