"""Arrays in the shared folder, memory-mapped by workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

_LOCAL: dict[str, str] = {}


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write ``array`` whole under ``name``; a repeated task replaces it by the same."""
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/.{name}-{(own := uuid.uuid4().hex)}") as f:
        np.save(f, array)
    store.move(f"{at}/.{name}-{own}", f"{at}/{name}.npy")


def get(folder: str, name: str) -> np.ndarray:
    """The array, mapped: from the shared folder if that is mounted, else from a copy that the executor keeps."""
    path = _local(folder)
    if path is None:
        path = _LOCAL.get(folder)
        if path is None:
            path = _LOCAL[folder] = tempfile.mkdtemp(prefix="arrays-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        if not os.path.exists(f"{path}/{name}.npy"):
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(f"{at}/{name}.npy") as source, open(f"{path}/.{name}-{os.getpid()}", "wb") as copy:
                while block := source.read(1 << 24):
                    copy.write(block)
            os.replace(f"{path}/.{name}-{os.getpid()}", f"{path}/{name}.npy")
    return np.load(f"{path}/{name}.npy", mmap_mode="r")


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress well where high bytes are alike."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as planes of their differences."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0))) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "<u8"), dtype=np.uint64) if data else np.empty(0, np.uint64)
