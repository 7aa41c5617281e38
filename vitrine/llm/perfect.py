"""Minimal perfect hashing of 64-bit keys with arrays alone.

Keys are thrown into a bit array of twice their number; those that are alone in
their place are done, and the others are thrown into a smaller array, until none
is left. A key's slot is how many bits are set before its own. The key of each
slot is stored, which tells strangers apart.
"""

from __future__ import annotations

import numpy as np

from .textbytes import U, mix

ROOM = 2
STEP = 0xD1B54A32D192ED03


def _places(keys: np.ndarray, turn: int, size: int) -> np.ndarray:
    return (((mix(keys + U((turn + 1) * STEP % 2**64)) >> U(32)) * U(size)) >> U(32)).astype(np.int64)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a perfect hash of distinct keys, fewer than 2^31: bits, ranks, sizes of the levels, and keys by slot."""
    bits, sizes, left = [np.zeros(0, bool)], [], keys
    while len(left):
        size = -(-ROOM * len(left) // 64) * 64
        place = _places(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[place]]
    words = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64)
    ranks = np.append(0, np.cumsum(np.bitwise_count(words)))[:-1].astype(np.uint32)
    out = {"bits": words, "ranks": ranks, "sizes": np.array(sizes, np.int64)}
    stored = np.empty(len(keys), U)
    stored[_slots(out, keys)] = keys
    return out | {"keys": stored}


def _slots(arrays: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, of some member for a stranger, or -1."""
    out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for turn, size in enumerate(arrays["sizes"].tolist()):
        at = start + _places(keys[left], turn, size)
        word, bit = at >> 6, (at & 63).astype(U)
        held = arrays["bits"][word]
        hit = (held >> bit) & U(1) == 1
        below = held[hit] & ((U(1) << bit[hit]) - U(1))
        out[left[hit]] = arrays["ranks"][word[hit]] + np.bitwise_count(below)
        left, start = left[~hit], start + size
    return out


def slots(arrays: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key that was built in, -1 for any other."""
    out = _slots(arrays, keys)
    some = np.flatnonzero(out >= 0)
    out[some[arrays["keys"][out[some]] != keys[some]]] = -1
    return out
