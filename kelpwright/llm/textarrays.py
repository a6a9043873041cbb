"""Arrow text columns as flat numpy arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; bounds the temporaries, cuts no text.
SLICE_BYTES = 2_000_000


@dataclass
class Points:
    """Code points of several texts laid end to end."""

    data: np.ndarray  # uint8, the UTF-8 bytes
    cps: np.ndarray  # uint32
    byte_of: np.ndarray  # int64, byte offset of each code point, then the end
    doc: np.ndarray  # int64, first code point of each text, then the end


def points(texts: pa.Array) -> Points:
    """The texts' code points; null counts as empty.

    Bytes that are not UTF-8 are replaced as Python's decoder replaces them.
    """
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = body.to_pybytes()[offsets[0] : offsets[-1]] if body is not None else b""
    try:
        wide = raw.decode("utf-8")
    except UnicodeDecodeError:
        parts = [raw[a - offsets[0] : b - offsets[0]].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return points(pa.array(parts, pa.large_utf8()))
    data = np.frombuffer(raw, np.uint8)
    cps = np.frombuffer(wide.encode("utf-32-le"), np.uint32)
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return Points(data, cps, byte_of, np.searchsorted(byte_of, offsets - offsets[0]))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive runs of rows of about SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
