"""Arrays in the shared folder, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write(uri: str, name: str, *arrays: np.ndarray) -> None:
    """One file with the arrays one after the other. A retried task writes the same
    bytes again; the file appears under its name only when it is whole."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        passing = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(passing) as f:
            for a in arrays:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
        store.move(passing, f"{root}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    passing = os.path.join(path, f".{name}.{uuid.uuid4().hex}")
    with open(passing, "wb") as f:
        for a in arrays:
            f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
    os.replace(passing, os.path.join(path, name))


def mapped(uri: str, name: str) -> memoryview:
    """The file's bytes, mapped. A folder in another store is read through an
    unnamed local file, which goes with the worker."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(f"{root}/{name}") as f, tempfile.TemporaryFile() as kept:
            while chunk := f.read(1 << 22):
                kept.write(chunk)
            kept.flush()
            return memoryview(mmap.mmap(kept.fileno(), 0, access=mmap.ACCESS_READ)) if kept.tell() else memoryview(b"")
    if not os.path.getsize(os.path.join(path, name)):
        return memoryview(b"")
    with open(os.path.join(path, name), "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
