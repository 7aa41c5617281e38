"""Removal of long repeated strings by prefix-free parsing.

A rolling hash over ``trigger`` bytes marks positions in the text; a phrase runs
from one mark to the end of the next. Marks depend on the text alone, so equal
strings are cut into equal phrases wherever they stand. The phrases are the
dictionary: a string of ``width`` bytes can only occur twice if every phrase
inside it does. Counting the dictionary over the corpus therefore leaves a small
set of candidate strings, and these alone are put into corpus order by their
fingerprints, which shows each string that starts more than once.

Keys travel as packed arrays: each block of documents sends, to each range of
keys, its distinct keys in order, and gets back one bit for each of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_text
from .textbytes import Hasher, U, joined, mix, slices, tidy, word_spans

KEYS = "bucket bigint, block bigint, keys binary, several binary"
BITS = "block bigint, bucket bigint, round int, repeated binary"
RESULT = "digest string, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated_words bigint"
#: Parts the keys of word passages from those of byte strings.
PASSAGE = U(0x5851F42D4C957F2D)
NONE = np.empty(0, np.int64)


class Block:
    """The distinct texts of one block, in an order that every pass sees alike."""

    def __init__(self, table: pa.Table, width: int, words: int, trigger: int, mean: int):
        copies: dict[str, int] = {}
        for text, n in zip(table.column("text").to_pylist(), table.column("copies").to_pylist(), strict=True):
            copies[text] = copies.get(text, 0) + n
        texts = sorted(copies)
        self.copied = np.array([copies[t] > 1 for t in texts], bool)
        self.data, self.offsets = joined([t.encode() for t in texts])
        self.width, self.words, self.trigger, self.mask = width, words, trigger, U(mean - 1)
        self.ranges = list(slices(self.offsets, 1 << 20))
        self.parsed: dict[int, tuple] = {}
        self.worded: dict[int, tuple] = {}

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]

    def phrases(self, a: int, b: int) -> tuple[Hasher, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hasher, bounds, and start, end and row of the phrases of rows a to b that a window can hold; parsed once."""
        if a in self.parsed:
            return self.parsed[a]
        data, bounds = self.part(a, b)
        hasher = Hasher(data)
        mark = np.flatnonzero((hasher.windows(self.trigger) & self.mask) == 0)
        row = np.searchsorted(bounds, mark, "right") - 1
        inside = mark + self.trigger <= bounds[row + 1]
        mark, row = mark[inside], row[inside]
        pair = np.flatnonzero((row[1:] == row[:-1]) & (mark[1:] + self.trigger - mark[:-1] <= self.width))
        self.parsed[a] = hasher, bounds, mark[pair], mark[pair + 1] + self.trigger, row[pair]
        return self.parsed[a]

    def phrase_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Key of every phrase, and whether its text has copies."""
        keys, many = [np.empty(0, U)], [np.empty(0, bool)]
        for a, b in self.ranges:
            hasher, _, start, end, row = self.phrases(a, b)
            keys.append(hasher.spans(start, end))
            many.append(self.copied[a + row])
        return np.concatenate(keys), np.concatenate(many)

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """Position, key and copied flag of each window all whose phrases are repeated, the number of those that are
        ``width`` bytes, and which are to be counted.

        After those come the passages of ``words`` words, whose position is that
        of their first word among all words of the block. A passage counts once
        for each text, as it must be in another text to be repeated.
        """
        places, keys, many, done = [NONE], [np.empty(0, U)], [np.empty(0, bool)], 0
        passages, passage_keys, passage_many, passage_texts, words_before = [NONE], [], [np.empty(0, bool)], [], 0
        for a, b in self.ranges:
            hasher, bounds, start, end, row = self.phrases(a, b)
            once = ~repeated[done : done + len(start)]
            done += len(start)
            n = int(bounds[-1])
            low, high = np.maximum(end[once] - self.width, bounds[row[once]]), start[once]
            spoilt = np.cumsum(np.bincount(low, minlength=n + 2) - np.bincount(high + 1, minlength=n + 2))[:n] > 0
            room = np.zeros(n + 1, np.int32)
            has = np.diff(bounds) >= self.width
            np.add.at(room, bounds[:-1][has], 1)
            np.add.at(room, bounds[1:][has] - self.width + 1, -1)
            at = np.flatnonzero((np.cumsum(room)[:n] > 0) & ~spoilt)
            places.append(at + self.offsets[a])
            keys.append(hasher.spans(at, at + self.width))
            many.append(self.copied[a + np.searchsorted(bounds, at, "right") - 1])

            first, last, of = self.word_spans(a, b)
            if len(first) >= self.words:
                i = np.flatnonzero(of[self.words - 1 :] == of[: len(of) - self.words + 1])
                x, y = first[i], last[i + self.words - 1]
                spoilt = np.searchsorted(end[once], y, "right") > np.searchsorted(start[once], x, "left")
                i, x, y = i[~spoilt], x[~spoilt], y[~spoilt]
                passages.append(i + words_before)
                passage_keys.append(mix(hasher.spans(x, y) ^ PASSAGE))
                passage_texts.append(a + of[i])
                passage_many.append(self.copied[a + of[i]])
            words_before += len(first)
        count = sum(map(len, places))
        texts, passage_key = np.concatenate([NONE, *passage_texts]), np.concatenate([np.empty(0, U), *passage_keys])
        order = np.lexsort((passage_key, texts))
        counted = np.ones(count + len(order), bool)
        counted[count + order[1:]] = (texts[order][1:] != texts[order][:-1]) | (passage_key[order][1:] != passage_key[order][:-1])
        return np.concatenate(places + passages), np.concatenate([*keys, passage_key]), np.concatenate(many + passage_many), count, counted

    def word_spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every word of rows a to b; found once."""
        if a not in self.worded:
            self.worded[a] = word_spans(*self.part(a, b))
        return self.worded[a]

    def words_in(self, passages: np.ndarray) -> np.ndarray:
        """For each text the number of its words that the passages, given by their first words, hold."""
        count = [len(self.word_spans(a, b)[0]) for a, b in self.ranges]
        total = sum(count)
        held = np.cumsum(np.bincount(passages, minlength=total + 1) - np.bincount(passages + self.words, minlength=total + self.words + 1)[: total + 1])[:total] > 0
        rows = np.concatenate([NONE, *(a + self.word_spans(a, b)[2] for a, b in self.ranges)])
        return np.bincount(rows[held], minlength=len(self.offsets) - 1)


def _packed(block: int, keys: np.ndarray, several: np.ndarray, shift: int) -> tuple[pa.Table, np.ndarray]:
    """A row for each range of keys; and each key's place among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1]) if len(keys) else np.empty(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    distinct = ordered[fresh]
    n = len(distinct)
    many = (np.bincount(place, minlength=n) > 1) | (np.bincount(place, weights=several, minlength=n) > 0)
    bucket = _buckets(distinct, shift)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else NONE
    ends = np.append(cut[1:], n)
    rows = {
        "bucket": pa.array(bucket[cut], pa.int64()),
        "block": pa.array(np.full(len(cut), block), pa.int64()),
        "keys": pa.array([distinct[i:j].tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary()),
        "several": pa.array([np.packbits(many[i:j]).tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary()),
    }
    return pa.table(rows), place


def _buckets(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)


def _answers(table: pa.Table, n_round: int, keys: np.ndarray, shift: int) -> np.ndarray:
    """The bit of each key, put together from the rows that came back."""
    distinct, place = np.unique(keys, return_inverse=True)
    bits = np.zeros(len(distinct), bool)
    bucket = _buckets(distinct, shift)
    for b, k, packed in zip(table.column("bucket").to_pylist(), table.column("round").to_pylist(), table.column("repeated").to_pylist(), strict=True):
        if k == n_round:
            i, j = np.searchsorted(bucket, [b, b + 1])
            bits[i:j] = np.unpackbits(np.frombuffer(packed, np.uint8), count=j - i)
    return bits[place]


def _count(n_round: int) -> Callable[[pa.Table], pa.Table]:
    """In one range of keys: which are in more than one block, or several times in one."""

    def run(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, U) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("several").to_pylist(), sent, strict=True)]
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        ordered, several = keys[order], np.concatenate(many)[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        group = np.cumsum(fresh) - 1
        repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=several) > 0)
        bits = np.empty(len(keys), bool)
        bits[order] = repeated[group]
        cuts = np.cumsum([0, *map(len, sent)])
        n = table.num_rows
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "round": pa.array(np.full(n, n_round), pa.int32()),
                "repeated": pa.array([np.packbits(bits[cuts[i] : cuts[i + 1]]).tobytes() for i in range(n)], pa.binary()),
            }
        )

    return run


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch become one row, so a hot text is few rows by the time it is dealt out."""
    for batch in batches:
        found = pa.table({"text": batch.column(0)}).group_by("text").aggregate([([], "count_all")])
        yield from pa.table({"text": found.column("text"), "copies": found.column("count_all")}).combine_chunks().to_batches()


def remove_repeats(docs: DataFrame, width: int = 400, words: int = 50, trigger: int = 16, mean: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """What is left of each text without its repeated ``width``-byte strings.

    A byte goes if a string of ``width`` bytes over it also starts anywhere
    else, in its own text or another; matches end with their text. Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    n_repeated_words, a row for each input row. The last counts the words in
    passages of ``words`` words that another document has too; these are only
    reported, as they may be shorter than ``width`` bytes.

    Null text is empty; texts shorter than ``width`` stay whole; equal rows are
    copies of each other whatever their doc_id; an empty table gives an empty
    result; further columns are ignored. ``trigger`` and ``mean`` (a power of
    two, the mean phrase) change the cost only.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select("doc_id", whole_text().alias("text"))
    long = rows.where(F.octet_length("text") >= min(width, 2 * words - 1)).select("text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, total / mean) / (1 << 18))))
    shift = 64 - bits

    def block_of(table: pa.Table) -> Block:
        return Block(table, width, words, trigger, mean)

    texts = long.mapInArrow(tidy(_collapse), "text string, copies bigint").withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    texts = texts.repartition(parts, "block")

    def send_phrases(table: pa.Table) -> pa.Table:
        keys, many = block_of(table).phrase_keys()
        return _packed(table.column("block")[0].as_py(), keys, many, shift)[0]

    def marked(block: Block, back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        keys, _ = block.phrase_keys()
        return block.candidates(_answers(back, 0, keys, shift))

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        _, keys, many, _, counted = marked(block_of(table), back)
        return _packed(table.column("block")[0].as_py() if table.num_rows else -1, keys[counted], many[counted], shift)[0]

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        block = block_of(table)
        places, keys, _, count, _ = marked(block, back)
        repeated = _answers(back, 1, keys, shift)
        starts = places[:count][repeated[:count]]
        passage_words = block.words_in(places[count:][repeated[count:]])
        found = []
        for i in range(len(block.offsets) - 1):
            a, b = int(block.offsets[i]), int(block.offsets[i + 1])
            own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
            if not len(own) and not passage_words[i]:
                continue
            gap = np.flatnonzero(own[1:] > own[:-1] + width)
            first, last = (own[np.append(0, gap + 1)], own[np.append(gap, len(own) - 1)] + width) if len(own) else (own, own)
            text = block.data[a:b].tobytes()
            kept, at = hashlib.sha256(), 0
            for i0, i1 in zip(first.tolist(), last.tolist(), strict=True):
                kept.update(text[at:i0])
                at = i1
            kept.update(text[at:])
            found.append((hashlib.sha256(text).hexdigest(), int((last - first).sum()), len(first), kept.hexdigest(), int(passage_words[i])))
        columns = list(zip(*found, strict=True)) or [[], [], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"])

    phrases = texts.groupBy("block").applyInArrow(send_phrases, KEYS).groupBy("bucket").applyInArrow(_count(0), BITS)
    windows = texts.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(send_windows, KEYS).groupBy("bucket").applyInArrow(_count(1), BITS)
    back = phrases.unionByName(windows)
    changed = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, RESULT)
    whole = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    return whole.join(changed, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        F.coalesce("n_repeated_words", F.lit(0).cast("long")).alias("n_repeated_words"),
    )
