"""Long exact spans shared between records, by content-defined chunking.

A gear rolling hash runs over the code points; a text is cut where the hash is
the smallest of some window, so equal passages are cut alike wherever they
stand.  With a gear window of GEAR and a cut window of CUT code points, any
passage of GEAR - 1 + 2 * CUT or more holds at least one whole chunk together
with the gear window before it, in every text that has the passage.  Chunks
are deduplicated by digest; a passage can only be shared where all chunks
surely cut alike are, and the runs that remain are verified at every position by hashes
of the whole minimum span.  Everything is counted by distinct record per hash,
never by pairs of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwright.llm.textarrays import points, slices
from kelpwright.storage import Workspace, table_bytes

#: Bytes on disk of a list of hits that may be broadcast.
BROADCAST_BYTES = 16_000_000
#: Code points that reach a 32-bit gear hash before they are shifted out.
GEAR = 32
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NEVER = np.uint64(2**64 - 1)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_window(min_span: int) -> int:
    """The widest cut window that still leaves a whole chunk in ``min_span``."""
    width = (min_span - GEAR + 1) // 2
    if width < 2:
        raise ValueError(f"spans shorter than {GEAR + 3} code points cannot be guaranteed a chunk")
    return width


class Rolling:
    """Hashes of any substring of a run of code points, from prefix sums."""

    def __init__(self, cps: np.ndarray, lane: int) -> None:
        base = _BASES[lane]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        n = len(cps)
        self.lane = lane
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        self.unshift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mix(cps, lane + 1) * powers[:n], dtype=np.uint64)])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.unshift[start] + (end - start).astype(np.uint64), self.lane)


def chunk_spans(cps: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each chunk with the gear window before it,
    and for each position where the window that begins there cuts.

    ``doc`` holds the first position of each text and the end of the last.
    """
    n = len(cps)
    h = (_mix(cps) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    step = 1
    while step < GEAR:
        older = np.zeros_like(h)
        older[step:] = h[: n - step] << np.uint32(step)
        h = h + older
        step *= 2
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:  # smallest of span positions, doubling
        shifted = np.full(n, _NEVER)
        shifted[: n - span] = key[span:]
        key = np.minimum(key, shifted)
        span *= 2
    if span < width:
        shifted = np.full(n, _NEVER)
        shifted[: max(0, n - (width - span))] = key[width - span :]
        key = np.minimum(key, shifted)
    # Windows that lie in one text and see only whole gear windows.
    length = np.diff(doc)
    windows = np.maximum(length - (GEAR - 1) - (width - 1), 0)
    text = np.repeat(np.arange(len(length)), windows)
    first = np.repeat(doc[:-1] + (GEAR - 1), windows)
    at = first + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    cuts = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = cuts[at]
    fresh = np.ones(len(cut), bool)
    fresh[1:] = (cut[1:] != cut[:-1]) | (text[1:] != text[:-1])
    cut, text = cut[fresh], text[fresh]
    pair = np.flatnonzero(text[1:] == text[:-1])
    return cut[pair] - (GEAR - 1), cut[pair + 1] + 1, text[pair], cuts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprints(min_span: int):
    width = cut_window(min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = points(part.column("text"))
                start, end, text, _ = chunk_spans(p.cps, p.doc, width)
                if not len(text):
                    continue
                digest = Rolling(p.cps, 0).span(start, end)
                order = np.lexsort((digest, text))
                digest, text = digest[order], text[order]
                once = np.ones(len(text), bool)
                once[1:] = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])
                ids = part.column("doc_id").take(pa.array(text[once]))
                times = np.diff(np.append(np.flatnonzero(once), len(text)))
                yield pa.RecordBatch.from_arrays([_signed(digest[once]), ids, pa.array(times)], names=["digest", "doc_id", "times"])

    return run


def _contexts(min_span: int):
    """Runs of candidate positions by the first chunk they surely share.

    A row holds the chunk's digest and the code points from its first candidate
    position to the end of the last one's span: at most a cut window of
    positions, so its text is bounded whatever the length of the record's.
    """
    width = cut_window(min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = points(part.column("text"))
                start, end, text, cuts = chunk_spans(p.cps, p.doc, width)
                if not len(text):
                    continue
                digest = Rolling(p.cps, 0).span(start, end)
                edge = np.searchsorted(text, np.arange(len(p.doc)))
                shared, crowded = (_listed(digest, edge, part.column(c)) for c in ("digests", "crowded"))
                # The first and the last window of cuts within [q, q + min_span)
                # cut every copy of it alike, and so do all between: position q
                # is a candidate if the chunks from the one to the other are shared.
                length = np.diff(p.doc)
                room = np.maximum(length - min_span + 1, 0)
                own = np.repeat(np.arange(len(length)), room)
                q = np.repeat(p.doc[:-1], room) + np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room)
                lo = np.searchsorted(start, cuts[q + GEAR - 1] - (GEAR - 1))
                hi = np.searchsorted(end, cuts[q + min_span - width] + 1, side="right")
                upto = np.concatenate([[0], np.cumsum(shared)])
                good = (hi > lo) & (upto[hi] - upto[np.minimum(lo, hi)] == hi - lo)
                q, own, lo = q[good], own[good], lo[good]
                if not len(q):
                    continue
                fresh = np.ones(len(q), bool)
                fresh[1:] = (lo[1:] != lo[:-1]) | (q[1:] != q[:-1] + 1)
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(q)) - 1
                a, z, lo, own = q[head], q[tail], lo[head], own[head]
                bytes_a, bytes_z = p.byte_of[a], p.byte_of[z + min_span]
                size = bytes_z - bytes_a
                upto = np.concatenate([[0], np.cumsum(size)])
                body = p.data[np.repeat(bytes_a - upto[:-1], size) + np.arange(upto[-1])]
                context = pa.StringArray.from_buffers(len(a), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(body))
                int32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [_signed(digest[lo]), pa.array(crowded[lo]), part.column("doc_id").take(pa.array(own)), int32(a - p.doc[:-1][own]), int32(start[lo] - a), context],
                    names=["digest", "crowded", "doc_id", "at", "lead", "context"],
                )

    return run


def _listed(digest: np.ndarray, edge: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each chunk's digest is in its own text's list."""
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    order = np.lexsort((known, owner))
    known, owner = known[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
    found = np.zeros(len(digest), bool)
    for k in range(len(lists)):
        own, (c, d) = known[bounds[k] : bounds[k + 1]], edge[k : k + 2]
        if len(own) and c < d:
            slot = np.searchsorted(own, digest[c:d])
            slot[slot == len(own)] = 0
            found[c:d] = own[slot] == digest[c:d]
    return found


class _Grams:
    """All positions of a batch of contexts: row, place in it, hashes."""

    def __init__(self, batch: pa.RecordBatch, min_span: int, second: bool = False) -> None:
        p = points(batch.column("context"))
        count = np.diff(p.doc) - min_span + 1
        self.row = np.repeat(np.arange(batch.num_rows), count)
        self.step = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        q = p.doc[self.row] + self.step
        self.h1 = Rolling(p.cps, 0).span(q, q + min_span)
        if second:
            self.h2 = (Rolling(p.cps, 1).span(q, q + min_span) >> np.uint64(32)).astype(np.uint32)


def _intervals(doc: pa.Array, row: np.ndarray, at: np.ndarray, min_span: int) -> pa.RecordBatch:
    """(doc_id, from, to) of runs of consecutive positions within a row."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(row)) - 1
    cols = [doc.take(pa.array(row[head])), pa.array(at[head].astype(np.int32)), pa.array((at[tail] + min_span).astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "begin", "end"])


def _verify(min_span: int):
    """Verifies contexts that arrive sorted by digest, digest by digest."""

    def check(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.combine_chunks().to_batches():
            digest, docs, lead, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("digest", "doc_id", "lead", "at"))
            g = _Grams(batch, min_span)
            if not len(g.row):
                continue
            # Copies of a span stand alike to the chunk: compare by place and hash.
            key = g.h1 ^ _mix((lead[g.row] - g.step).astype(np.int64).view(np.uint64), 3)
            group = np.cumsum(np.append(True, digest[1:] != digest[:-1]))[g.row]
            order = np.lexsort((key, group))
            k, gr, d = key[order], group[order], docs[g.row[order]]
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (gr[1:] != gr[:-1])))
            several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
            hit = np.zeros(len(order), bool)
            hit[order] = np.repeat(several, np.diff(np.append(first, len(order))))
            if hit.any():
                yield _intervals(batch.column("doc_id"), g.row[hit], (at[g.row] + g.step)[hit], min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            digest = held["digest"].to_numpy()
            done = int(np.searchsorted(digest, digest[-1])) if len(digest) else 0  # the last digest may go on
            if done >= 4096:
                yield from check(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from check(held)

    return run


def _grams(min_span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                g = _Grams(part, min_span, second=True)
                place = part.column("at").to_numpy(zero_copy_only=False)[g.row] + g.step
                cols = [_signed(g.h1), pa.array(g.h2.view(np.int32)), part.column("doc_id").take(pa.array(g.row)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "doc_id", "begin"])

    return run


def _in_several_docs(df: DataFrame, *keys: str, times: Column | None = None) -> DataFrame:
    """Keys held by two or more distinct doc_ids and how often they are held."""
    counts = df.groupBy(*keys).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum(F.lit(1) if times is None else times).alias("n_held"))
    return counts.where("a < b").select(*keys, "n_held")


def shared_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_span: int = 150, crowd: int = 20_000) -> DataFrame:
    """Per record with any, the characters it shares: doc_id, shared_chars.

    A code point is shared if it lies in a run of at least ``min_span`` code
    points that also occurs in the text of another doc_id.  Null and empty
    texts, and rows with a null id, take no part; repeated rows count once;
    where an id stands for several texts, shared positions of any of them
    count.  Texts may be of any length.  Other columns are ignored.  An empty
    table gives no rows.

    Spans are equal where two 64-bit hashes of theirs are (one hash, the place
    beside the shared chunk and its digest, or both hashes): the texts
    themselves are not compared once more.

    Contexts of a chunk meet in one task and are verified there.  Chunks that
    occur more than ``crowd`` times, in however few records, are not gathered:
    their spans are counted by hash with partial aggregation and joined back,
    which no single key holds up.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & (F.length("text") >= min_span)
    )
    space = Workspace(spark, "spans")
    prints = space.write(docs.mapInArrow(_fingerprints(min_span), "digest bigint, doc_id bigint, times bigint"), "prints")
    # A table of its own, so that AQE may split the records of a common chunk in the join.
    several = space.write(_in_several_docs(prints, "digest", times=F.col("times")), "several")
    many = F.when(F.col("n_held") > crowd, F.col("digest"))
    hits = prints.join(several, "digest").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"), F.collect_set(many).alias("crowded"))
    hits = space.write(hits, "hits")
    space.drop("prints")
    space.drop("several")
    # A small list of hits is sent to the texts; beside a large one it is hashed,
    # so that whole texts need not be sorted.
    small = table_bytes(hits) <= BROADCAST_BYTES
    suspects = docs.join(F.broadcast(hits) if small else hits.hint("shuffle_hash"), "doc_id")
    schema = "digest bigint, crowded boolean, doc_id bigint, at int, lead int, context string"
    contexts = space.write(suspects.mapInArrow(_contexts(min_span), schema), "contexts")
    space.drop("hits")

    gathered = contexts.where("NOT crowded").repartition("digest").sortWithinPartitions("digest")
    near = gathered.mapInArrow(_verify(min_span), "doc_id bigint, begin int, end int")
    grams = contexts.where("crowded").mapInArrow(_grams(min_span), "h1 bigint, h2 int, doc_id bigint, begin int")
    far = grams.join(_in_several_docs(grams, "h1", "h2"), ["h1", "h2"], "left_semi").select("doc_id", "begin", (F.col("begin") + min_span).alias("end"))

    runs = near.unionByName(far).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs"))
    # Each run covers its code points, less those that the runs before it cover.
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["upto"], r["begin"]))).alias("n"), F.greatest(s["upto"], r["end"]).alias("upto")
        ),
        lambda s: s["n"],
    )
    return runs.select("doc_id", covered.alias("shared_chars"))
