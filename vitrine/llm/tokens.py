"""Word-level BPE ids for large batches, equal to those of the ``tokenizers`` library.

The tokenizer drops white space, so a text's ids are those of its words one
after another. Distinct words of a batch are found by hash and encoded once; a
word of letters, digits and plain ASCII signs is encoded by array operations
over all such words at a time, any other by the library itself.
"""

from __future__ import annotations

import json

import numpy as np

from .textbytes import Hasher, slices, word_spans

LONGEST = 64  # bytes of a word that is encoded here
CACHE_WORDS = 1 << 20
NO_RANK = np.int64(1 << 30)

LETTER, DIGIT, SIGN = 1, 2, 3


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encoder for a lower-casing word BPE whose words end in ``</w>``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        self.final = np.array([vocab[s + end] for s in _byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._index(key, made)
        kind = np.full(256, SIGN, np.int8)
        kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
        kind[range(0x30, 0x3A)] = DIGIT
        self.kind = kind
        odd = np.ones(256, bool)  # bytes that send a word to the library
        odd[0x21:0x7F] = False
        odd[0x80:0xC0] = False  # what follows 0xC3 in two-byte letters
        odd[[0x27, 0x3C]] = True  # contractions and special tokens
        odd[0xC3] = False
        self.odd = odd
        self.keys = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.rare: dict[bytes, np.ndarray] = {}

    def _index(self, key: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: rank and made symbol by pair of symbols."""
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK)
        self.made = np.zeros(1 << self.bits, np.int64)
        left = np.arange(len(key))
        at = self._home(key)
        while len(left):
            free = self.table[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.table[at[put]], self.rank[at[put]], self.made[at[put]] = key[left[put]], left[put], made[left[put]]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table place of each pair that merges, or -1."""
        key = (left << 20) | right
        at = self._home(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.table[at]
            hit = seen == key[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (seen >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE over many pieces at a time: in each, the leftmost pair of least rank merges, until none does."""
        n = len(bounds) - 1
        piece = np.repeat(np.arange(n), np.diff(bounds))
        place = np.full(len(symbols), -1, np.int64)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        place[inner] = self._find(symbols[inner], symbols[inner + 1])
        done_piece, done_symbol = [], []
        while len(symbols):
            rank = np.where(place >= 0, self.rank[place], NO_RANK)
            begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), begin)
            at = best & 0xFFFFFFFF
            on = (best >> 32) < NO_RANK
            if not on.all():
                alive = np.repeat(on, np.diff(np.append(begin, len(piece))))
                done_piece.append(piece[~alive])
                done_symbol.append(symbols[~alive])
                shift = np.cumsum(alive) - 1
                at = shift[at[on]]
                symbols, piece, place = symbols[alive], piece[alive], place[alive]
                if not len(symbols):
                    break
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, piece, place = symbols[keep], piece[keep], place[keep]
            size = len(symbols)
            place[at] = -1
            right = at[(at + 1 < size)]
            right = right[piece[right + 1] == piece[right]]
            left = at[at > 0] - 1
            left = left[piece[left] == piece[left + 1]]
            for side in (right, left):
                place[side] = self._find(symbols[side], symbols[side + 1])
        pieces, out = np.concatenate([np.empty(0, np.int64), *done_piece]), np.concatenate([np.empty(0, np.int64), *done_symbol])
        order = np.argsort(pieces, kind="stable")
        return out[order], np.searchsorted(pieces[order], np.arange(n + 1))

    def _encode_plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their bounds for words of plain bytes."""
        size = end - start
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        index = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
        raw = data[index]
        kind = self.kind[raw]
        capital = (raw >= 0x41) & (raw <= 0x5A)
        capital[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        raw = raw + capital * np.uint8(32)
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[bounds] = True
        fresh[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut = np.flatnonzero(fresh)
        symbols = self.inner[raw]
        symbols[cut[1:] - 1] = self.final[raw[cut[1:] - 1]]
        ids, at = self._merge(symbols, cut)
        return ids.astype(np.int32), at[np.searchsorted(cut, bounds)]

    def _encode_library(self, word: bytes) -> np.ndarray:
        ids = self.rare.get(word)
        if ids is None:
            ids = np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, np.int32)
            if len(word) <= LONGEST:
                if len(self.rare) >= CACHE_WORDS // 8:
                    self.rare.clear()
                self.rare[word] = ids
        return ids

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of distinct words that are not in the cache."""
        strange = np.append(0, np.cumsum(self.odd[data] | (np.append(False, data[:-1] == 0xC3) & ((data == 0x97) | (data == 0xB7)))))
        plain = (strange[end] == strange[start]) & (end - start <= LONGEST)
        ids, at = self._encode_plain(data, start[plain], end[plain])
        if plain.all():
            return ids, at
        other = [self._encode_library(data[i:j].tobytes()) for i, j in zip(start[~plain], end[~plain], strict=True)]
        size = np.empty(len(start), np.int64)
        size[plain] = np.diff(at)
        size[~plain] = [len(x) for x in other]
        bounds = np.append(0, np.cumsum(size))
        out = np.empty(bounds[-1], np.int32)
        out[np.repeat(plain, size)] = ids
        out[np.repeat(~plain, size)] = np.concatenate(other)
        return out, bounds

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch of texts, and their bounds by text."""
        parts, sizes = [np.empty(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in slices(offsets):
            ids, bounds = self._encode_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(ids)
            sizes.append(np.diff(bounds))
        return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, row = word_spans(data, offsets)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        words, first, place = np.unique(Hasher(data).spans(start, end), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, words), max(0, len(self.keys) - 1))
        known = self.keys[near] == words if len(self.keys) else np.zeros(len(words), bool)
        ids, at = self._distinct(data, start[first[~known]], end[first[~known]])
        # the cache's ids and the new ones side by side
        base = len(self.ids)
        pool = np.concatenate([self.ids, ids])
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        slot = self.slot[near[known]] if len(self.keys) else np.empty(0, np.int64)
        begin[known], size[known] = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        begin[~known], size[~known] = at[:-1] + base, np.diff(at)
        count = size[place]
        total = np.append(0, np.cumsum(count))
        out = pool[np.repeat(begin[place] - total[:-1], count) + np.arange(total[-1])]
        if len(self.keys) < CACHE_WORDS and not known.all():
            where = np.searchsorted(self.keys, words[~known])
            self.slot = np.insert(self.slot, where, len(self.begin) - 1 + np.arange(len(at) - 1))
            self.keys = np.insert(self.keys, where, words[~known])
            self.begin = np.concatenate([self.begin, at[1:] + base])
            self.ids = pool
        return out, total[np.searchsorted(row, np.arange(len(offsets)))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its cache lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
