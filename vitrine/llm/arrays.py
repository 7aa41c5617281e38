"""Numeric arrays as bytes: messages between tasks, and files in the shared folder that tasks memory-map.

A file is written under a name of its own and then renamed, so a task that runs
twice leaves one whole file. Keys are dealt into ``parts`` equal ranges of 64
bits, which a sorted array of keys meets one after another.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from .common import shared_dir
from .textbytes import BASE, U, mix

ALIGN = 64


def pack(**arrays: np.ndarray) -> bytes:
    """Named one-dimensional arrays as one string of bytes."""
    head, at, body = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        body.append(raw + b"\0" * (-len(raw) % ALIGN))
        at += len(body[-1])
    raw = json.dumps(head).encode()
    return (len(raw).to_bytes(8, "little") + raw).ljust(-(-(8 + len(raw)) // ALIGN) * ALIGN, b"\0") + b"".join(body)


def unpack(data) -> dict[str, np.ndarray]:
    """The arrays of ``pack``, as views of ``data``, which may be a mapped file."""
    size = int.from_bytes(bytes(data[:8]), "little")
    start = -(-(8 + size) // ALIGN) * ALIGN
    return {name: np.frombuffer(data, kind, n, start + at) for name, (kind, n, at) in json.loads(bytes(data[8 : 8 + size])).items()}


def new_folder(spark: SparkSession) -> str:
    """A folder for arrays in the shared one."""
    return f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"


def _local(folder: str) -> str | None:
    """The path of a folder in a file system that is mounted here, else None."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None if "://" in folder else folder


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    data, path = pack(**arrays), _local(folder)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        with store.open_output_stream(draft := f"{path}/.{name}-{uuid.uuid4().hex}") as f:
            f.write(data)
        store.move(draft, f"{path}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(data)
    os.replace(draft, f"{path}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped where its folder is mounted and else read; None if there is none."""
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return None
        with store.open_input_file(f"{path}/{name}") as f:
            return unpack(f.read())
    if not os.path.exists(f"{path}/{name}"):
        return None
    return unpack(np.memmap(f"{path}/{name}", np.uint8, "r"))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(left * BASE + right)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each key."""
    return (((keys >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Each range that sorted keys meet, with the first and one past the last of its keys."""
    if len(keys):
        at = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(at)).tolist():
            yield i, int(at[i]), int(at[i + 1])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is there."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(keys)))


def added(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of their numbers."""
    if not len(keys):
        return (keys, *columns)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return (ordered[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in columns))


def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each asked key among known ones, both sorted, and whether it is there."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked
