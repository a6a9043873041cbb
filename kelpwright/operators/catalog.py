"""Each user's best unseen items of a whole catalog, exactly.

The catalog lies in cells of near vectors, each with its bounding box.  No item
of a cell scores above the product of a user's vector with the best corner of
its box, so a user meets only the cells whose corner reaches the n-th best score
found so far; the others cannot hold an entry of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwright.arrays import open_arrays, save_arrays
from kelpwright.functions.scalars import norm
from kelpwright.session import shuffle_width
from kelpwright.storage import Workspace

#: Items of a cell, items of a file (what a task holds to lay out cells) and users scored at a time.
CELL, FILE_ITEMS, USER_BLOCK = 128, 250_000, 2048
#: Cells that every user meets first, and entries that are held before they are ranked.
_FIRST, _ENTRIES = 4, 1_000_000


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def cells(v: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each ``size`` in turn are near each other."""
    order, open_ = np.arange(len(v)), [(0, len(v))]
    while open_:
        a, z = open_.pop()
        if z - a <= size:
            continue
        part = v[order[a:z]]
        middle = size * (-(-(z - a) // size) // 2)
        widest = int(np.argmax(part.max(0) - part.min(0)))
        order[a:z] = order[a:z][np.argpartition(part[:, widest], middle)]
        open_ += [(a, a + middle), (a + middle, z)]
    return order


def _laid_out(folder: str, item: str, cell: int):
    """(file, longest) of the files that hold a task's items in cells."""

    def saved(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = cells(v, cell)
        ids, v = ids[order], v[order]
        starts = np.arange(0, len(v), cell)
        file = save_arrays(folder, {"ids": ids, "v": v, "low": np.minimum.reduceat(v, starts), "high": np.maximum.reduceat(v, starts)})
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([float(np.sqrt((v * v).sum(1).max()))])], names=["file", "longest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(item).to_numpy(zero_copy_only=False), _vectors(b.column("v"))
            usable = np.isfinite(v).all(1)  # others have no finite score with anyone
            held.append((ids[usable], v[usable]))
            if sum(len(i) for i, _ in held) >= 2 * FILE_ITEMS:
                yield saved(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if sum(len(i) for i, _ in held):
            yield saved(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


class _Lists:
    """A block of users and the n best unseen items of each so far."""

    def __init__(self, p: np.ndarray, of: np.ndarray, held: np.ndarray, n: int, cell: int = CELL) -> None:
        self.p, self.n, self.cell = p, n, cell
        self.known = np.unique(held)
        self.pairs = np.sort(of * len(self.known) + np.searchsorted(self.known, held))
        self.row, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(p), -np.inf)  # the n-th best so far
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _unseen(self, row: np.ndarray, near: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(row), bool)
        at = np.minimum(np.searchsorted(self.known, near), len(self.known) - 1)
        pair = row * len(self.known) + at
        spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return (self.known[at] != near) | (self.pairs[spot] != pair)

    def _rank(self) -> None:
        if not self.met:
            return
        row, near, score = (np.concatenate(c) for c in zip(*self.met, strict=True))
        self.met, score = [], np.round(score, 9)
        able = np.flatnonzero((score >= self.floor[row]) & np.isfinite(score))
        able = able[self._unseen(row[able], near[able])]
        row, near, score = np.concatenate([self.row, row[able]]), np.concatenate([self.near, near[able]]), np.concatenate([self.score, score[able]])
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.n - 1
        self.floor[row[last]] = score[last]
        best = place < self.n
        self.row, self.near, self.score = row[best], near[best], score[best]

    def _visit(self, users: np.ndarray, cell: np.ndarray, c: dict[str, np.ndarray], slack: np.ndarray) -> None:
        order = np.argsort(cell, kind="stable")
        users, cell = users[order], cell[order]
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]) if len(cell) else np.zeros(1, int)
        least, entries = self.floor - slack, 0
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, own = int(cell[a]) * self.cell, users[a:z]
            s = self.p[own] @ c["v"][at : at + self.cell].T
            x, y = np.nonzero(s >= least[own][:, None])
            if len(x):
                self.met.append((own[x], c["ids"][at + y], s[x, y]))
                entries += len(x)
                if entries >= _ENTRIES:
                    self._rank()
                    least, entries = self.floor - slack, 0
        self._rank()

    def meet(self, c: dict[str, np.ndarray]) -> None:
        """Take in what a file's items change."""
        low, high = c["low"], c["high"]
        reach = np.maximum(self.p, 0) @ high.T + np.minimum(self.p, 0) @ low.T
        # Scores count after rounding; beyond that, what sums of products may be off by.
        slack = 1e-9 + 1e-13 * (np.abs(self.p) @ np.maximum(np.abs(low), np.abs(high)).max(0))
        first = min(_FIRST, reach.shape[1])
        top = np.argpartition(-reach, first - 1, axis=1)[:, :first]
        every = np.arange(len(self.p))[:, None]
        top = top[every, np.argsort(-reach[every, top], axis=1)]
        for part in (top[:, :1], top[:, 1:]):
            x, y = np.nonzero(reach[every, part] >= (self.floor - slack)[:, None])
            self._visit(x, part[x, y], c, slack)
        reach[every, top] = np.nan
        self._visit(*np.nonzero(reach >= (self.floor - slack)[:, None]), c, slack)


def _best_items(files: list[str], user: str, item: str, n: int, cell: int):
    """(user, item, score, rank): each user's n best unseen items of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog: list[dict] = []
        for batch in batches:
            catalog = catalog or [open_arrays(f) for f in files]
            for at in range(0, batch.num_rows, USER_BLOCK):
                part = batch.slice(at, USER_BLOCK)
                p = _vectors(part.column("v"))
                part = part.take(pa.array(np.flatnonzero(np.isfinite(p).all(1))))
                if not part.num_rows:
                    continue
                seen = part.column("seen")
                of = np.repeat(np.arange(part.num_rows), np.diff(seen.offsets.to_numpy()))
                lists = _Lists(_vectors(part.column("v")), of, seen.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, cell)
                for c in catalog:
                    lists.meet(c)
                rank = (np.arange(len(lists.row)) - np.searchsorted(lists.row, lists.row) + 1).astype(np.int32)
                columns = [part.column(user).take(pa.array(lists.row)), pa.array(lists.near), pa.array(lists.score), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=[user, item, "score", "rank"])

    return run


def catalog_lists(users: DataFrame, items: DataFrame, user: str, item: str, n: int, cell: int = CELL) -> DataFrame:
    """(user, item, score, rank): the n best items of each user.

    ``users``: (user, v, seen), ``items``: (item, v), ids being integers.  By
    the product of the vectors rounded to 9 decimals, ties by id; seen items
    take no place.  Files of the longest vectors come first.
    """
    space = Workspace(items.sparkSession, "catalog")
    length = norm("v")
    items = space.write(items.select(F.col(item).cast("long").alias(item), "v", length.alias("length")), "items")
    parts = -(-items.count() // FILE_ITEMS)
    rows = items.repartitionByRange(parts, "length") if parts > 1 else items.repartition(1)
    laid = rows.select(item, "v").mapInArrow(_laid_out(space.path("cells"), item, cell), "file string, longest double").collect()
    space.drop("items")
    files = [r["file"] for r in sorted(laid, key=lambda r: -r["longest"])]
    kind = dict(users.dtypes)[user]
    asked = users.select(user, "v", "seen").repartition(4 * shuffle_width(users.sparkSession), user)
    return asked.mapInArrow(_best_items(files, user, item, n, cell), f"{user} {kind}, {item} bigint, score double, rank int")
