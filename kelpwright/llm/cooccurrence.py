"""Pairs of items that appear together, and how surprising that is.

Pair counts are exact.  They are compared with a bipartite configuration model
fitted so that every item keeps its expected frequency and every record its
expected size: an item of frequency class f is in a record of size s with
probability x_f y_s / (1 + x_f y_s).  Under it a pair's count is a sum of
independent draws of unequal probability (Poisson-binomial), whose upper tail
is taken by the saddlepoint formula; Benjamini-Hochberg controls false finds.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwright.storage import Workspace

#: Pairs combined in memory at a time.
COMBINE_PAIRS = 4_000_000
#: Records of an item beyond which its pairs are counted in several tasks.
SPLIT_RECORDS = 200_000
#: Frequencies (sizes) up to the first number are classes of their own; beyond it
#: a class spans the second, as a part of the frequency.  With less than 2**63
#: occurrences this is at most 40,000 (4,200) classes.
_FREQUENCIES, _SIZES = (4096, 0.001), (256, 0.01)
_BINS_PER_DECADE, _MAX_DECADES = 20, 1000


def _add_up(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(key, return_counts=True)
    key, of = np.unique(key, return_inverse=True)
    return key, np.bincount(of, n, len(key)).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_a, item_b, n_ab) of rows (item_a, later items) sorted by item_a."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    last: tuple[int, np.ndarray, np.ndarray] | None = None  # the item that may go on, its counts

    def count(done: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, last
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        n = None
        if last is not None:  # the first item's earlier counts
            a, b = np.concatenate([np.full(len(last[1]), last[0]), a]), np.concatenate([last[1], b])
            n = np.concatenate([last[2], np.ones(len(b) - len(last[1]), np.int64)])
        held, size, last = [], 0, None
        items = a[np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])]
        low, span = int(b.min()), int(b.max()) - int(b.min()) + 1
        if span < 2**62 // len(items):
            key, n = _add_up(np.searchsorted(items, a) * np.int64(span) + (b - low), n)
            a, b = items[key // span], key % span + low
        else:
            others, code = np.unique(b, return_inverse=True)
            key, n = _add_up(np.searchsorted(items, a) * np.int64(len(others)) + code, n)
            a, b = items[key // len(others)], others[key % len(others)]
        upto = len(a) if done else int(np.searchsorted(a, a[-1]))
        if not done:
            last = (int(a[-1]), b[upto:], n[upto:])
        if upto:
            yield pa.RecordBatch.from_arrays([pa.array(x[:upto]) for x in (a, b, n)], names=["item_a", "item_b", "n_ab"])

    for batch in batches:
        later = batch.column("later")
        held.append((np.repeat(batch.column("item_a").to_numpy(), pc.list_value_length(later).to_numpy()), later.flatten().to_numpy()))
        size += len(held[-1][0])
        if size >= COMBINE_PAIRS:
            yield from count(False)
    if size or last is not None:
        if not held:
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield from count(True)


def fit_configuration(freq: np.ndarray, n_items: np.ndarray, size: np.ndarray, n_records: np.ndarray, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """x by frequency class and y by size class, by fixed-point iteration.

    Warns if frequencies are not met to a ten-millionth after ``steps``.
    """
    total = float(n_records.sum())
    f = np.minimum(freq.astype(float), total * (1 - 1e-9))
    s = np.minimum(size.astype(float), n_items.sum() * (1 - 1e-9))
    x, y = f / math.sqrt(max(1.0, float((f * n_items).sum()))), s / math.sqrt(max(1.0, float((f * n_items).sum())))
    change = math.inf
    for _ in range(steps):
        old = x
        x = f / ((n_records * y) / (1 + np.outer(x, y))).sum(1)
        y = s / ((n_items * x)[:, None] / (1 + np.outer(x, y))).sum(0)
        change = float(np.max(np.abs(x / old - 1)))
        if change < 1e-10:
            break
    if change > 1e-7:
        warnings.warn(f"configuration model: the last of {steps} steps changed a weight by {change:.1e} of itself", stacklevel=2)
    return x, y


def log10_tail(q: np.ndarray, trials: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(X >= n), X a sum of trials[s] draws of probability q[:, s].

    Saddlepoint tail with the lattice correction (Lugannani and Rice), clipped
    to [-_MAX_DECADES, 0].
    """
    q = np.clip(q, 1e-300, 1 - 1e-15)
    mean = (q * trials).sum(1)
    t = np.log(np.maximum(n, 0.5) / mean)
    top = trials.sum()
    full = n >= top  # all draws succeed: exact
    target = np.minimum(n, top - 1e-9).astype(float)
    for _ in range(60):
        e = q * np.exp(t)[:, None]
        p = e / (1 - q + e)
        k1, k2 = (p * trials).sum(1), (p * (1 - p) * trials).sum(1)
        step = np.clip((target - k1) / np.maximum(k2, 1e-300), -1, 1)
        t = t + step
        # K is stationary in t here: an error of 1e-7 in t is one of 1e-14 in the exponent.
        if np.max(np.abs(step), initial=0) < 1e-7:
            break
    e = q * np.exp(t)[:, None]
    k0 = (np.log1p(q * np.expm1(t)[:, None]) * trials).sum(1)
    p = e / (1 - q + e)
    k2 = (p * (1 - p) * trials).sum(1)
    w = np.sign(t) * np.sqrt(np.maximum(0, 2 * (t * target - k0)))
    u = -np.expm1(-t) * np.sqrt(k2)
    mills = np.array([math.erfc(v / math.sqrt(2)) * math.exp(v * v / 2) * math.sqrt(math.pi / 2) if v < 25 else (1 - 1 / v**2 + 3 / v**4) / v for v in np.clip(w, -25, None)])
    with np.errstate(divide="ignore", invalid="ignore"):
        logp = -w * w / 2 - 0.5 * math.log(2 * math.pi) + np.log(mills + 1 / u - 1 / w)
    flat = (np.abs(w) < 1e-4) | ~np.isfinite(logp)
    logp = np.where(flat, math.log(0.5), logp)
    logp = np.where(full, (np.log(q) * trials).sum(1), logp)
    return np.clip(logp / math.log(10), -_MAX_DECADES, 0)


def _surprise(freq: np.ndarray, x: np.ndarray, y: np.ndarray, trials: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                col = lambda c, part=part: part.column(c).to_numpy(zero_copy_only=False)
                # Rare pairs are many and alike: each case is computed once.
                case, of = np.unique(np.stack([col("n_a"), col("n_b"), col("n_ab")]), axis=1, return_inverse=True)
                xa, xb = (x[np.searchsorted(freq, c)][:, None] * y for c in case[:2])
                q = xa / (1 + xa) * (xb / (1 + xb))
                logp = log10_tail(q, trials, case[2])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((q * trials).sum(1)[of]), pa.array(logp[of])], names=[*part.schema.names, "expected", "log10_p"])

    return run


def baskets(df: DataFrame, record: str, items: str) -> DataFrame:
    """(record, items): each record's distinct non-null items, ascending.

    A record logged with different lists has the items of all of them; records
    with a null id or no item are left out.
    """
    own = F.array_sort(F.array_distinct(F.filter(F.col(items).cast("array<bigint>"), lambda i: i.isNotNull())))
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), own.alias("items")).where("size(items) > 0")
    lists = rows.groupBy("record").agg(F.collect_set("items").alias("lists"))
    several = F.array_sort(F.array_distinct(F.flatten("lists")))
    return lists.select("record", F.when(F.size("lists") == 1, F.col("lists")[0]).otherwise(several).alias("items"))


def _counted(base: DataFrame, counts: DataFrame, min_count: int = 1) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b of the pairs found together min_count times.

    A record sends each of its items the later ones: all pairs of an item are
    then counted in its task, and only counts leave it.  An item of more than
    SPLIT_RECORDS records has several tasks, whose counts are added up.
    """
    rows = base.select(F.posexplode("items").alias("at", "item_a"), "items")
    rows = rows.select("item_a", F.expr("slice(items, at + 2, size(items))").alias("later")).where("size(later) > 0")
    busy = counts.where(F.col("n") > SPLIT_RECORDS).select(F.col("item").alias("item_a"), F.ceil(F.col("n") / SPLIT_RECORDS).alias("tasks"))
    split = not busy.isEmpty()
    if split:
        task = F.coalesce(F.pmod(F.xxhash64("later"), F.col("tasks")), F.lit(0))
        rows = rows.join(busy, "item_a", "left").select("item_a", task.alias("task"), "later").repartition("item_a", "task")
    else:
        rows = rows.repartition("item_a")
    pairs = rows.sortWithinPartitions("item_a").select("item_a", "later").mapInArrow(_count_pairs, "item_a bigint, item_b bigint, n_ab bigint")
    if split:
        pairs = pairs.groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"))
    pairs = pairs.where(F.col("n_ab") >= min_count)
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b")


def _classes(values: DataFrame, n: str, exact: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(highest, mean, number) of the values of each class; ``count`` says how often one is there."""
    step = F.floor(F.log(F.greatest(F.col(n), F.lit(exact)) / F.lit(float(exact))) / width)
    own = F.when(F.col(n) <= exact, F.col(n)).otherwise(exact + 1 + step)
    rows = values.groupBy(own.alias("c")).agg(F.max(n).alias("top"), F.sum(F.col(n) * F.col("count")).alias("s"), F.sum("count").alias("m")).orderBy("top").collect()
    top, s, m = (np.array([r[c] for r in rows], np.int64) for c in ("top", "s", "m"))
    return top, s / np.maximum(m, 1), m


def _basket_tables(space: Workspace, df: DataFrame, record: str, items: str) -> tuple[DataFrame, DataFrame]:
    base = space.write(baskets(df, record, items).select("items"), "baskets")
    return base, space.write(base.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")), "counts")


def cooccurring_pairs(df: DataFrame, record: str, items: str, min_count: int = 1, fdr: float = 0.01) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, n, lift, expected, log10_p, significant.

    Every pair found together at least ``min_count`` times.  lift is
    n_ab * n / (n_a * n_b); ``expected`` and ``log10_p`` are the mean and upper
    tail under the fitted null; ``significant`` holds at false-discovery rate
    ``fdr`` over all pairs of items, p-values being rounded up to a twentieth
    of a decade for it; every pair found together is tested and ranked, whatever
    ``min_count``, which only cuts the output.  An item counts once a record; null lists, null
    elements and empty lists are left out, repeated rows count once, an empty
    table gives no rows, other columns are ignored.

    Items send later ones of their records to one task each, which hands on
    counts only.  Classes of frequencies and of sizes, of a fixed bound, are all
    that reaches the driver for the fit.
    """
    space = Workspace(df.sparkSession, "pairs")
    base, counts = _basket_tables(space, df, record, items)
    _, size, trials = _classes(base.groupBy(F.size("items").cast("long").alias("s")).count(), "s", *_SIZES)
    top, freq, m = _classes(counts.groupBy("n").count(), "n", *_FREQUENCIES)
    n, n_items = int(trials.sum()), int(m.sum())
    x, y = fit_configuration(freq, m, size, trials) if n else (np.zeros(0), np.zeros(0))
    schema = "item_a bigint, item_b bigint, n_ab bigint, n_a bigint, n_b bigint, expected double, log10_p double"
    scored = space.write(_counted(base, counts).mapInArrow(_surprise(top, x, y, trials.astype(float)), schema), "scored")
    space.drop("baskets")
    space.drop("counts")

    bin_ = F.floor(-F.col("log10_p") * _BINS_PER_DECADE)
    tests, seen, cutoff = n_items * (n_items - 1) / 2, 0, None
    for r in scored.groupBy(bin_.alias("bin")).count().orderBy(F.desc("bin")).collect():
        seen += r["count"]
        if -r["bin"] / _BINS_PER_DECADE <= math.log10(fdr * seen / tests):
            cutoff = r["bin"]
    significant = F.lit(False) if cutoff is None else bin_ >= cutoff
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    found = scored.where(F.col("n_ab") >= min_count)
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), lift.alias("lift"), "expected", "log10_p", significant.alias("significant"))
