"""Files of numpy arrays in the shared folder, mapped rather than read.

A task writes a file under a name of its own and hands the name on in its
rows, so only files of committed attempts are ever met.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

import numpy as np
from pyarrow.fs import FileSystem

_HEADER = 4096


def save_arrays(folder: str, arrays: Mapping[str, np.ndarray]) -> str:
    """Write the arrays to a new file in ``folder``; its name."""
    path = f"{folder}/{uuid.uuid4().hex}.bin"
    fs, inner = FileSystem.from_uri(path)
    fs.create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    places, at = {}, _HEADER
    for name, a in arrays.items():
        places[name] = (a.dtype.str, a.shape, at)
        at += a.nbytes
    with fs.open_output_stream(inner) as out:
        out.write(json.dumps(places).encode().ljust(_HEADER))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")
    return path


def open_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped, from a copy on local disk where it is remote."""
    fs, inner = FileSystem.from_uri(path)
    if path.startswith("file:"):
        raw = np.memmap(inner, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy:  # the map outlives the name
            with fs.open_input_stream(inner) as stream:
                while part := stream.read(1 << 24):
                    copy.write(part)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    out = {}
    for name, (kind, shape, at) in json.loads(bytes(raw[:_HEADER])).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(raw[at : at + size]).view(kind).reshape(shape)
    return out
