"""Arrays in the shared folder, written by executors and memory-mapped by workers.

A path on a mounted file system (``file:`` or none) is mapped where it lies. From another store (hdfs, s3, ...) an array
is read into memory whole; nothing is put into a worker's own folders.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local(path: str) -> str | None:
    """The path on the mounted file system, or None for another store."""
    u = urlparse(path)
    return (u.path if u.scheme else path) if u.scheme in ("", "file") else None


def save(path: str, array: np.ndarray) -> None:
    """Write ``array`` to ``path`` at once: a task that runs again, or twice at a time, puts the same bytes there."""
    here = local(path)
    if here is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        part = f"{here}.{uuid.uuid4().hex}.part"
        array.tofile(part)
        os.replace(part, here)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(memoryview(array).cast("B") if len(array) else b"")
    store.move(part, name)


def load(path: str, dtype) -> np.ndarray:
    """The array at ``path``, memory-mapped where it can be."""
    here = local(path)
    if here is None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)
    if os.path.getsize(here) == 0:
        return np.zeros(0, dtype)
    return np.memmap(here, dtype, "r")
