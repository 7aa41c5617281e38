"""Phrase collocations: word sequences that stand together more than their parts do.

Lengths are found one after another. A phrase can only be frequent if the
phrases inside it are, so tasks send the hashes of those phrases alone whose
parts are known to be frequent, with counts that need not go beyond the least
one. The task of a range of hashes keeps those that reach it and writes a
minimal perfect hash of them. In a last pass tasks map all these files, look up
each phrase of their texts, verify it by the stored key, and count into an array
by slot; the arrays are summed in two rounds. What a candidate's parts count is
then read by slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import perfect
from .arrays import by_part, join, load, new_folder, pack, part_of, save, unpack
from .blocks import blocks
from .common import shuffle_partitions, staged, whole_text
from .textbytes import Hasher, U, joined, lowered, row_bounds, slices, tidy, utf8, word_spans

LONGEST = 4
#: Groups in which the tasks' arrays are summed first, and bytes of arrays that a task holds.
SALTS, HELD_BYTES = 16, 64 << 20
SENT = "level int, part bigint, data binary"
DONE = "level int, part bigint, n bigint"
FOUND = "level int, part bigint, salt int, data binary, slot bigint, lang string, phrase string, n bigint"
CUTS = "level int, part bigint, slot bigint, lang string, phrase string, a bigint, l bigint, r bigint, score bigint, dropped boolean"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_PIECE_END = _BREAK.copy()
_PIECE_END[0x0A:0x0E] = True


@dataclass
class Words:
    """The words of a block: place in its bytes, text, hash, key with the language, and whether the next one follows in the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    key: np.ndarray
    follows: np.ndarray
    home: np.ndarray
    langs: list[str]


def _lang_keys(langs: list[str]) -> np.ndarray:
    data, offsets = joined([x.encode() for x in langs])
    return Hasher(data).spans(offsets[:-1], offsets[1:])


def parse(block: pa.Table) -> Words:
    """``block``: lang and text. ``home`` tells texts apart by 32 bits."""
    data, offsets = utf8(block.column("text").chunk(0))
    data = lowered(data)
    lang = block.column("lang").chunk(0).dictionary_encode()
    langs = lang.dictionary.to_pylist()
    starts, ends, rows, hashes, follows, homes = [], [], [], [], [], []
    for a, b in slices(offsets):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, bounds, _BREAK)
        hasher = Hasher(part)
        stops = np.append(0, np.cumsum(_PIECE_END[part]))
        next_one = np.zeros(len(start), bool)
        next_one[:-1] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        starts.append(start + offsets[a])
        ends.append(end + offsets[a])
        rows.append(row + a)
        hashes.append(hasher.spans(start, end))
        follows.append(next_one)
        homes.append((hasher.spans(bounds[:-1], bounds[1:]) >> U(32)).astype(np.uint32))
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    key = join(_lang_keys(langs)[lang.indices.to_numpy()][row], hashed)
    return Words(data, np.concatenate(starts), np.concatenate(ends), row, hashed, key, np.concatenate(follows), np.concatenate(homes), [langs[i] for i in lang.indices.to_pylist()])


def _sent(level: int, keys: np.ndarray, homes: np.ndarray, least: int, parts: int) -> list[tuple]:
    """Messages of the distinct keys: counts up to ``least`` and the least home of each."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.minimum(np.diff(np.append(first, len(keys))), least).astype(np.uint8 if least < 256 else np.int64)
    home, keys = np.minimum.reduceat(homes[order], first), keys[first]
    return [(level, i, pack(keys=keys[a:b], counts=counts[a:b], homes=home[a:b])) for i, a, b in by_part(keys, parts)]


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SENT_FIELDS = pa.schema([("level", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])
DONE_FIELDS = pa.schema([("level", pa.int32()), ("part", pa.int64()), ("n", pa.int64())])
FOUND_FIELDS = pa.schema([("level", pa.int32()), ("part", pa.int64()), ("salt", pa.int32()), ("data", pa.binary()), ("slot", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


@dataclass
class Frequent:
    """The frequent phrases found so far, as files of perfect hashes by length and range."""

    folder: str
    parts: int

    def known(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Which keys, in any order, are of frequent phrases."""
        distinct, place = np.unique(keys, return_inverse=True)
        return (self.slots(level, distinct) >= 0)[place]

    def slots(self, level: int, keys: np.ndarray) -> np.ndarray:
        """The slot of each sorted key in its range, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for i, a, b in by_part(keys, self.parts):
            arrays = load(self.folder, f"slots{level}-{i}")
            if arrays is not None:
                out[a:b] = perfect.slots(arrays, keys[a:b])
        return out

    def counts(self, level: int, keys: np.ndarray) -> np.ndarray:
        """What frequent phrases count, keys in any order."""
        distinct, place = np.unique(keys, return_inverse=True)
        out, slot = np.zeros(len(distinct), np.int64), self.slots(level, distinct)
        for i, a, b in by_part(distinct, self.parts):
            out[a:b] = load(self.folder, f"counts{level}-{i}")["counts"][slot[a:b]]
        return out[place]

    def candidates(self, words: Words, levels: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each level the first words and the keys of phrases all whose shorter phrases that are known by now are frequent."""
        if min(levels) == 1:
            yield 1, np.arange(len(words.key)), words.key
        if max(levels) == 1:
            return
        single = self.known(1, words.key)
        at = np.flatnonzero(words.follows[:-1] & single[:-1] & single[1:])
        key = join(words.key[at], words.hash[at + 1])
        if 2 in levels:
            yield 2, at, key
        if max(levels) == 2:
            return
        sure = self.known(2, key)
        double = np.zeros(len(words.key) + 1, bool)
        double[at[sure]] = True
        at, key = at[sure], key[sure]
        for level in range(3, max(levels) + 1):
            on = double[at + level - 2]
            at = at[on]
            key = join(key[on], words.hash[at + level - 1])
            yield level, at, key

    def make(self, least: int):
        """In one range of keys of one length: a perfect hash of those that count ``least`` in all tasks together."""

        def run(group: tuple, table: pa.Table) -> pa.Table:
            level, part = (k.as_py() for k in group)
            sent = [unpack(x) for x in table.column("data").to_pylist()]
            keys, counts, homes = (np.concatenate([x[n] for x in sent]) for n in ("keys", "counts", "homes"))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            some = np.add.reduceat(counts[order].astype(np.int64), first) >= least
            keys, homes = keys[first][some], np.minimum.reduceat(homes[order], first)[some]
            if len(keys):
                arrays = perfect.build(keys)
                stored = np.empty(len(keys), np.uint32)
                stored[perfect.slots(arrays, keys)] = homes
                save(self.folder, f"slots{level}-{part}", **arrays, homes=stored)
            return pa.table([[level], [part], [len(keys)]], schema=DONE_FIELDS)

        return run

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of counts by slot; the phrases whose home is here, with their slots; words of each language."""
        held: dict[tuple[int, int], np.ndarray] = {}
        size, totals = 0, {}

        def arrays() -> Iterator[pa.RecordBatch]:
            salt = TaskContext.get().partitionId() % SALTS
            yield from _batches([(level, i, salt, zlib.compress(pack(counts=x), 1), None, None, None, None) for (level, i), x in sorted(held.items())], FOUND_FIELDS)

        for block in blocks(batches):
            words = parse(block)
            for lang, n in zip(words.langs, np.bincount(words.row, minlength=block.num_rows).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            for level, at, key in self.candidates(words, tuple(range(1, LONGEST + 1))):
                keys, first, place = np.unique(key, return_index=True, return_inverse=True)
                times, slot = np.bincount(place, minlength=len(keys)), np.full(len(keys), -1, np.int64)
                home = np.zeros(len(keys), np.uint32)
                for i, a, b in by_part(keys, self.parts):
                    known = load(self.folder, f"slots{level}-{i}")
                    if known is None:
                        continue
                    slot[a:b] = perfect.slots(known, keys[a:b])
                    hit = a + np.flatnonzero(slot[a:b] >= 0)
                    if len(hit):
                        if (level, i) not in held:
                            held[level, i] = np.zeros(len(known["keys"]), np.int64)
                            size += held[level, i].nbytes
                        held[level, i] += np.bincount(np.repeat(slot[hit], times[hit]), minlength=len(known["keys"]))
                        home[hit] = known["homes"][slot[hit]]
                if level > 1:
                    yield from _batches(self._texts(words, level, at, keys, slot, home, place), FOUND_FIELDS, 1 << 12)
            if size >= HELD_BYTES:
                yield from arrays()
                held, size = {}, 0
        yield from arrays()
        yield from _batches([(0, -1, 0, None, None, lang, None, n) for lang, n in totals.items()], FOUND_FIELDS, 1 << 12)

    def _texts(self, words: Words, level: int, at: np.ndarray, keys: np.ndarray, slot: np.ndarray, home: np.ndarray, place: np.ndarray) -> list[tuple]:
        """A row for each phrase that occurs here in its home."""
        here = np.flatnonzero((slot[place] >= 0) & (words.home[words.row[at]] == home[place]))
        own, first = np.unique(place[here], return_index=True)
        begin = at[here[first]]
        part = part_of(keys[own], self.parts).tolist()
        texts = (words.data[i:j].tobytes() for i, j in zip(words.start[begin].tolist(), words.end[begin + level - 1].tolist(), strict=True))
        langs = (words.langs[r] for r in words.row[begin].tolist())
        return [(level, p, 0, None, s, lang, b" ".join(text.split()).decode(), None) for p, s, lang, text in zip(part, slot[own].tolist(), langs, texts, strict=True)]

    def cuts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and score of each candidate at its lowest cut, and the shorter ones that it makes superfluous."""
        for block in blocks(batches, 1 << 20):
            level = block.column("level").to_numpy()
            for k in range(2, LONGEST + 1):
                rows = block.filter(pa.array(level == k)).combine_chunks()
                if rows.num_rows:
                    yield from self._cut(k, rows).to_batches()

    def _cut(self, k: int, rows: pa.Table) -> pa.Table:
        data, offsets = utf8(rows.column("phrase").chunk(0))
        start, end, row = word_spans(data, offsets)
        hashes = Hasher(data).spans(start, end)[row_bounds(row, rows.num_rows)[:-1, None] + np.arange(k)]
        lang = rows.column("lang").chunk(0).dictionary_encode()
        lang_key = _lang_keys(lang.dictionary.to_pylist())[lang.indices.to_numpy()]
        keys, counts = {}, {}
        for i in range(k):
            key = join(lang_key, hashes[:, i])
            for j in range(i + 1, k + 1):
                keys[i, j] = key
                counts[i, j] = self.counts(j - i, key)
                key = join(key, hashes[:, j]) if j < k else key
        a = counts[0, k]
        whole = a.astype(object) * 2_000_000
        scores = np.stack([whole // (counts[0, c].astype(object) + counts[c, k]) for c in range(1, k)]).astype(np.int64)
        cut = scores.argmin(axis=0)
        pick = lambda sides: np.choose(cut, sides) if k > 2 else sides[0]
        own = {"level": rows.column("level"), "part": rows.column("part"), "slot": rows.column("slot"), "lang": rows.column("lang"), "phrase": rows.column("phrase")}
        own |= {"a": a, "l": pick([counts[0, c] for c in range(1, k)]), "r": pick([counts[c, k] for c in range(1, k)]), "score": scores.min(axis=0), "dropped": np.zeros(len(a), bool)}
        tables = [pa.table(own)]
        for (i, j), key in keys.items():
            if 2 <= j - i < k:
                inside = np.unique(key[100 * a.astype(object) >= 80 * counts[i, j].astype(object)])
                n = len(inside)
                gone = {"level": np.full(n, j - i, np.int32), "part": part_of(inside, self.parts), "slot": self.slots(j - i, inside)}
                gone |= {f.name: pa.nulls(n, f.type) for f in tables[0].schema if f.name not in (*gone, "dropped")} | {"dropped": np.ones(n, bool)}
                tables.append(pa.table(gone).select(tables[0].column_names))
        return pa.concat_tables(tables)


def _total(last: bool, folder: str):
    """The sum of the tasks' arrays of one range, written in the last round."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        level, part = group[0].as_py(), group[1].as_py()
        total = sum(unpack(zlib.decompress(x))["counts"] for x in table.column("data").to_pylist())
        if last:
            save(folder, f"counts{level}-{part}", counts=total)
            return pa.table([[level], [part], [len(total)]], schema=DONE_FIELDS)
        return pa.table([[level], [part], [zlib.compress(pack(counts=total), 1)]], schema=SENT_FIELDS)

    return run


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each lang the ``most`` phrases of two to four words that hold together best.

    Texts in lower case (A-Z) are cut into pieces at ``. , ; : ! ?`` and line
    breaks, and those into words at blanks and tabs. A phrase that occurs ``least``
    times in its lang, a, is scored by floor(2000000 a / (l + r)) at its lowest
    cut into parts that occur l and r times; n counts the lang's words. A phrase
    inside a longer one with four fifths of its occurrences or more is left out.

    Null text is empty, null lang is ``und``; repeated rows count each; a lang
    without such phrases has no rows, and so has an empty table; further columns
    are ignored. Phrases are told apart by 64-bit hashes: at 1e8 different ones
    that are sent, two are taken for one with odds of about 3 in 10,000.
    """
    spark = docs.sparkSession
    frequent = Frequent(new_folder(spark), shuffle_partitions(spark))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))

    for levels in ((1,), (2,), tuple(range(3, LONGEST + 1))):

        def send(batches: Iterator[pa.RecordBatch], levels: tuple[int, ...] = levels) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                words = parse(block)
                for level, at, key in frequent.candidates(words, levels):
                    yield from _batches(_sent(level, key, words.home[words.row[at]], least, frequent.parts), SENT_FIELDS)

        rows.mapInArrow(tidy(send), SENT).groupBy("level", "part").applyInArrow(frequent.make(least), DONE).agg(F.sum("n")).first()

    found = staged(rows.mapInArrow(tidy(frequent.count), FOUND))
    sums = found.where("data IS NOT NULL").groupBy("level", "part", "salt").applyInArrow(_total(False, frequent.folder), SENT)
    sums.groupBy("level", "part").applyInArrow(_total(True, frequent.folder), DONE).agg(F.sum("n")).first()

    phrases = found.where("phrase IS NOT NULL").select("level", "part", "slot", "lang", "phrase").distinct()
    judged = phrases.mapInArrow(tidy(frequent.cuts), CUTS).groupBy("level", "part", "slot").agg(F.max("dropped").alias("dropped"), F.max(F.struct("phrase", "lang", "a", "l", "r", "score")).alias("c"))
    words = found.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = judged.where("NOT dropped").select("c.*").withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
