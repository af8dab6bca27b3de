"""Arrays in the shared folder, mapped into memory by the tasks that read them.

On a path that machines mount, tasks map the files themselves. In other stores a task copies a file
once into an unnamed temporary file and maps that; nothing stays behind when the task ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np


def _mounted(uri: str) -> str | None:
    parts = urlsplit(uri)
    if parts.scheme == "":
        return uri
    return unquote(parts.path) if parts.scheme == "file" else None


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file at once; a second attempt of the same task replaces it by equal content."""
    data = np.ascontiguousarray(array)
    path = _mounted(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        data.tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(memoryview(data).cast("B"))


def map_array(folder: str, name: str, dtype: type) -> np.ndarray:
    path = _mounted(folder)
    if path is not None:
        path = f"{path}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{root}/{name}") as stream:
        while block := stream.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype, "r") if copy.tell() else np.empty(0, dtype)
