"""Files that workers read and write in the shared folder, by any file system that pyarrow opens."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def temporary(path: str) -> str:
    """A name beside path that no other attempt of the same task uses."""
    return f"{path}.{uuid.uuid4().hex}.tmp"


def commit(fs: pafs.FileSystem, temp: str, path: str) -> None:
    """Moves a finished file to its name. Attempts of a task write equal bytes, so the last one may win."""
    fs.move(temp, path)


def put(uri: str, data: bytes) -> None:
    fs, path = opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(temp := temporary(path)) as out:
        out.write(data)
    commit(fs, temp, path)


def get(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """An array in a shared file, memory-mapped. A store that isn't mounted here is copied to a nameless local file first."""
    fs, path = opened(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local, fs.open_input_stream(path, compression=None) as f:
        while chunk := f.read(1 << 22):
            local.write(chunk)
        local.flush()
        return np.memmap(local, dtype=dtype, mode="r") if local.tell() else np.empty(0, dtype)
