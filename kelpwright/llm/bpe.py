"""Byte-level BPE of a whole corpus through a pair occurrence index.

The words of a partition are reduced to distinct ones; an index maps each
adjacent pair of symbols to all its positions in them.  Ranks that are active
are applied in ascending order: all positions of the pair are merged at once
and the lists of the pairs that this creates are extended.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kelpwright.llm.textarrays import Points, points, slices

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: UTF-8 bytes of text whose distinct words share one index.
INDEX_BYTES = 48_000_000
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary among the installed tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, prop in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(prop, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


def word_starts(p: Points) -> np.ndarray:
    """Code-point positions at which the words of byte-level BPE begin.

    Words are runs of letters, of numbers or of other characters, each with one
    space before it if there is one; English clitics after an apostrophe; and
    white space, whose last character is left to the following word.
    """
    n = len(p.cps)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = _classes()[p.cps]
    first = np.zeros(n + 1, bool)
    first[p.doc] = True
    start = first.copy()
    start[1:n] |= cls[1:] != cls[:-1]

    # The last white-space character before a word of the same text.
    last = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~first[1:n])
    start[last] = True
    start[last[p.cps[last] == 32] + 1] = False

    # Clitics: an apostrophe that begins a word, with the letters right after it.
    at = np.flatnonzero((p.cps == 39) & start[:n])
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    one = p.cps[at + 1]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], p.cps[np.minimum(at + 2, n - 1)], 0)
    code = lambda s: [ord(c) for c in s]
    short = np.isin(one, code("stmd"))
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    hit = short | long
    at, size = at[hit], np.where(short[hit], 1, 2)
    start[at + 1] = False
    start[at + 1 + size] = True
    return np.flatnonzero(start[:n])


class PairIndexEncoder:
    """Ids of words under a rank file (one base64 token and its rank a line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 20 | right] = rank
        self.pairs = np.array(sorted(merges), np.int64)
        self.pair_rank = np.array([merges[k] for k in self.pairs.tolist()], np.int64)

    def _active(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys can merge, and their slot in the pair table."""
        slot = np.searchsorted(self.pairs, keys)
        slot[slot == len(self.pairs)] = 0
        return self.pairs[slot] == keys, slot

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and each word's offset into them."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size = np.diff(offsets)
        offsets = offsets - offsets[0]
        n = int(offsets[-1])
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        base = np.frombuffer(words.buffers()[1], np.int64)[words.offset]
        sym = self.byte_id[np.frombuffer(words.buffers()[2], np.uint8)[base : base + n]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        used = size > 0
        nxt[offsets[1:][used] - 1] = -1
        prv[offsets[:-1][used]] = -1

        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def add(pos: np.ndarray) -> None:
            keys = (sym[pos] << 20) | sym[nxt[pos]]
            ok, slot = self._active(keys)
            pos, slot = pos[ok], slot[ok]
            if not len(pos):
                return
            order = np.argsort(slot, kind="stable")
            pos, slot = pos[order], slot[order]
            cuts = np.flatnonzero(slot[1:] != slot[:-1]) + 1
            begin = [0, *cuts.tolist(), len(pos)]
            heads = slot[begin[:-1]]
            for s, r, a, b in zip(heads.tolist(), self.pair_rank[heads].tolist(), begin[:-1], begin[1:], strict=True):
                known = index.get(s)
                if known is None:
                    index[s] = [pos[a:b]]
                    heapq.heappush(heap, (r, s))
                else:
                    known.append(pos[a:b])

        add(np.flatnonzero(nxt >= 0))
        while heap:
            rank, slot = heapq.heappop(heap)
            parts = index.pop(slot)
            pair = int(self.pairs[slot])
            left, right = pair >> 20, pair & 0xFFFFF
            pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
            pos = pos[(sym[pos] == left) & (nxt[pos] >= 0)]
            pos = pos[sym[nxt[pos]] == right]
            if len(pos) > 1:
                pos = np.sort(pos)
                pos = pos[np.append(True, pos[1:] != pos[:-1])]
                if left == right:  # in a run of equal symbols every other pair merges
                    fresh = np.append(True, nxt[pos[:-1]] != pos[1:])
                    at = np.arange(len(pos))
                    pos = pos[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = rank, -1
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            add(np.concatenate([before[before >= 0], pos[has]]))

        alive = sym >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive].astype(np.int32), upto[offsets]


@functools.cache
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def _gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[offsets[r]:offsets[r+1]] for each r of rows, end to end."""
    size = offsets[rows + 1] - offsets[rows]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(offsets[rows] - (end - size), size) + np.arange(total)]


class CorpusEncoder:
    """Encodes slices of a partition that share one pair occurrence index."""

    def __init__(self, path: str) -> None:
        self.enc = encoder(path)
        self.held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]] = []
        self.bytes = 0

    def hold(self, batch: pa.RecordBatch, text: str) -> None:
        p = points(batch.column(text))
        start = word_starts(p)
        cut = np.append(p.byte_of[start], len(p.data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(p.data)])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.held.append((batch, codes, np.searchsorted(start, p.doc), coded.dictionary))
        self.bytes += len(p.data)

    def release(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Callable[[], np.ndarray]]]:
        """(batch, token offsets of its rows, the flat ids) for what is held."""
        if not self.held:
            return
        every = pa.concat_arrays([d.cast(pa.large_binary()) for *_, d in self.held]).dictionary_encode()
        to_global = every.indices.to_numpy(zero_copy_only=False)
        flat, offsets = self.enc.encode(every.dictionary)
        at = 0
        for batch, codes, doc_words, local in self.held:
            rows = to_global[at : at + len(local)][codes]
            at += len(local)
            upto = np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])
            yield batch, upto[doc_words], lambda rows=rows: _gather(flat, offsets, rows)
        self.held, self.bytes = [], 0


def _encoding(df: DataFrame, text: str, keep: Sequence[str], field: T.StructField, path: str, column: Callable) -> DataFrame:
    clash = [c for c in keep if c == field.name]
    if clash:
        raise ValueError(f"column {field.name} would be written twice")
    schema = T.StructType([*(df.schema[c] for c in keep), field])
    own = "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = CorpusEncoder(path)

        def out() -> Iterator[pa.RecordBatch]:
            for batch, offsets, ids in corpus.release():
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column(offsets, ids)], names=[*keep, field.name])

        for batch in batches:
            for part in slices(batch, own):
                corpus.hold(part, own)
                if corpus.bytes >= INDEX_BYTES:
                    yield from out()
        yield from out()

    return df.select(*keep, df[text].alias(own)).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), output: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and the token ids of each row's text; one row out per row in.

    Null and empty texts give the empty list.  Strings that look like special
    tokens are ordinary text.  Repeated rows repeat; null ids pass through;
    columns not in ``keep`` are dropped, so clashing names cannot arise.
    Narrow: no shuffle, memory bounded by INDEX_BYTES of text and its ids.
    """
    field = T.StructField(output, T.ArrayType(T.IntegerType(), False), False)
    column = lambda offsets, ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids(), pa.int32()))
    return _encoding(df, text, keep, field, vocabulary or default_vocabulary(), column)


def count_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), output: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """As :func:`encode_corpus`, with the number of ids in their place."""
    column = lambda offsets, ids: pa.array(np.diff(offsets), pa.int64())
    return _encoding(df, text, keep, T.StructField(output, T.LongType(), False), vocabulary or default_vocabulary(), column)
