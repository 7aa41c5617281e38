"""Vectorised word and substring hashing over the UTF-8 bytes of Arrow strings.

A batch of texts is one byte array plus offsets. With ``H`` the prefix sums of
``(byte + 1) * BASE**position`` modulo 2**64, the hash of any substring is
``(H[end] - H[start]) * BASE**-start``, so all words, shingles or windows of a
batch are hashed with a handful of array operations and no per-row Python.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
SLICE_BYTES = 1 << 20

if TaskContext.get() is not None:  # in a worker only: gives freed batches back at once
    pa.set_memory_pool(pa.system_memory_pool())


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which a worker, which waits for its next task, keeps no freed memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        with contextlib.suppress(AttributeError, OSError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n, grown by doubling and kept up to 16 MB."""
    table = _powers.get(int(base))
    if table is None or len(table) <= n:
        size = max(1 << 16, 1 << (int(n) + 1).bit_length())
        table = np.full(size, base, U)
        table[0] = 1
        np.cumprod(table, out=table)
        if size <= 2 << 20:
            _powers[int(base)] = table
    return table[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    if buffer is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Hasher:
    """Substring hashes of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _power_table(BASE, n)[:n], out=self.prefix[1:])
        self.inverse = _power_table(INVERSE, n)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.empty(0, U)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n] + U(width))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run without ASCII white space.

    ``breaks`` marks further bytes that part words and belong to none.
    """
    word = ~_SPACE[data] if breaks is None else ~(_SPACE | breaks)[data]
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    fresh = np.zeros(n + 1, bool)  # a row starts here
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | fresh[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's entries in a sorted row-number array."""
    return np.searchsorted(row, np.arange(n + 1))


def shingles(hashes: np.ndarray, row: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words of a row, and its offsets by row.

    A row of fewer words has one shingle of all of them; one of none has none.
    """
    bounds = row_bounds(row, n)
    count = np.diff(bounds)
    total = len(hashes)
    value = np.zeros(total, U)
    place = np.arange(total) - bounds[:-1][row]
    left = count[row] - place
    for j in range(min(width, total)):
        here = hashes[j:] if j else hashes
        inside = left[: total - j] > j
        value[: total - j] = np.where(inside, value[: total - j] * BASE + here, value[: total - j])
    keep = (left >= width) | ((place == 0) & (count[row] < width))
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(n + 1, np.int64)
    np.cumsum(many, out=out[1:])
    return mix(value[keep] + np.minimum(left[keep], width).astype(U)), out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capitals made small."""
    out = _LOWER[data]
    if len(out) > 1:
        out[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) * np.uint8(32)
    return out


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII capitals made small."""
    return _SMALL[data]
