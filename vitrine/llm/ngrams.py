"""Language-model scores: interpolated modified Kneser-Ney n-grams.

Tasks count the n-grams of a block of texts and send them, in packed arrays, to
ranges of their 64-bit hashes, over which a context is spread by a salt. The task of a range adds the counts up, writes
them as a file of sorted hashes and counts, and sends on what the order below
needs: each distinct n-gram counts once for the n-gram without its first word.
Sums over the words that follow a context meet in ranges of contexts. Scoring
maps those files and looks up the sorted distinct n-grams of a block, so a
worker's memory is that of its block, and the files are pages that the workers
of a machine share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import added, by_part, distinct, find, join, load, new_folder, pack, part_of, save, unpack
from .blocks import blocks
from .common import shuffle_partitions, whole_text
from .textbytes import Hasher, U, lowered, row_bounds, slices, tidy, utf8, word_spans

#: What stands for the start and the end of a text; no word hashes to them but by chance.
START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Tokens that are sorted at once, and bytes of text that are scored at once.
PIECE, SCORE_BYTES = 1 << 22, 8 << 20
#: Discounts where a corpus is too small to estimate them.
PLAIN = (0.5, 1.0, 1.5)
GRAMS, CONTEXTS, WORDS, TOTALS = range(4)
MESSAGE = "kind int, level int, part bigint, data binary, totals array<bigint>"
NONE = np.empty(0, np.int64)
#: Bits of a key that hold the place of its context.
PLACE = U(0xFFFF << 48)


def salts(parts: int) -> int:
    """Places among which the n-grams of one context are spread, so that a third of all n-grams is no more than other ranges hold."""
    return -(-parts // 3)


def gram_keys(context: np.ndarray, words: np.ndarray, parts: int) -> np.ndarray:
    """Hash of each n-gram; its upper bits are from the context and a salt of the word, so a range holds few contexts."""
    return (join(context, words % U(salts(parts))) & PLACE) | (join(context, words) & ~PLACE)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the least bytes."""
    most = int(numbers.max(initial=0))
    return numbers.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(k).max))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and its end, and the texts' bounds."""
    found, counts = [np.empty(0, U)], [NONE]
    for a, b in slices(offsets):
        part, bounds = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, bounds)
        size = np.diff(row_bounds(row, b - a)) + 1
        out = np.full(int(size.sum()), END)
        out[np.arange(len(start)) + row] = Hasher(part).spans(start, end)
        found.append(out)
        counts.append(size)
    return np.concatenate(found), np.append(0, np.cumsum(np.concatenate(counts)))


def contexts(words: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the order - 1, ..., 1 tokens before each; START stands before a text."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out: list[np.ndarray] = []
    for k in range(1, order):
        before = np.full(len(words), START)
        before[k:] = np.where(place[k:] >= k, words[:-k], START)
        out.insert(0, join(before, out[0]) if out else before)
    return out


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    for i in range(0, len(rows), 64):
        columns = list(zip(*rows[i : i + 64], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "level", "part", "data", "totals"])


def _word_rows(kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    """Messages of sorted words and their counts."""
    return [(kind, 1, i, pack(keys=keys[a:b], counts=_narrow(counts[a:b])), None) for i, a, b in by_part(keys, parts)]


def _gram_rows(columns: list[np.ndarray], words: np.ndarray, parts: int) -> list[tuple]:
    """Messages of the n-grams of contexts (the longest first) and words, each counted as often as it is given.

    A message has its distinct contexts, with how many n-grams follow each, and
    its distinct words, to which the n-grams refer by place.
    """
    if not columns:
        return _word_rows(GRAMS, *distinct(words), parts)
    out = []
    for a in range(0, len(words), PIECE):
        above = [c[a : a + PIECE] for c in columns]
        _, first, context = np.unique(above[0], return_index=True, return_inverse=True)
        word, number = np.unique(words[a : a + PIECE], return_inverse=True)
        bits = max(1, int(PIECE - 1).bit_length())
        part = part_of(gram_keys(above[0], words[a : a + PIECE], parts), parts)
        grams, counts = distinct((part << (2 * bits)) | (context << bits) | number)
        at = np.searchsorted(grams >> (2 * bits), np.arange(parts + 1))
        mask = (1 << bits) - 1
        for i in np.flatnonzero(np.diff(at)).tolist():
            own = grams[at[i] : at[i + 1]]
            follows, runs = distinct((own >> bits) & mask)
            named, place = np.unique(own & mask, return_inverse=True)
            data = {f"context{k}": c[first[follows]] for k, c in enumerate(above)}
            out.append((GRAMS, len(columns) + 1, i, pack(**data, runs=_narrow(runs), words=word[named], place=_narrow(place), counts=_narrow(counts[at[i] : at[i + 1]])), None))
    return out


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of a byte each; 255 stands for those in a list of larger ones."""
    large = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "large": large, "large_counts": counts[large]}


def _counts(arrays: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    out = arrays["counts"][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = arrays["large_counts"][np.searchsorted(arrays["large"], at[large])]
    return out


def _totals(level: int, counts: np.ndarray, words: int = 0) -> tuple:
    """How many counts are 1, 2, 3 and 4, their sum, and how many are 1, 2 and more; how many words there are."""
    ones = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return (TOTALS, level, -1, None, [*ones, int(counts.sum()), len(counts), words])


def _merge(folder: str, parts: int):
    """In one range of one kind of messages: adds counts up, writes them, and sends on what other ranges need."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, level, part = (k.as_py() for k in key)
        if kind == TOTALS:
            sums = np.array(table.column("totals").to_pylist(), np.int64).sum(axis=0)
            rows = [(TOTALS, level, -1, None, sums.tolist())]
        else:
            sent = [unpack(x) for x in table.column("data").to_pylist()]
            column = lambda name: np.concatenate([x[name] for x in sent])
            if kind == CONTEXTS:
                keys, *sums = added(column("keys"), *(column(n) for n in ("total", "ones", "twos", "more")))
                save(folder, f"contexts{level}-{part}", keys=keys, **{n: _narrow(x) for n, x in zip(("total", "ones", "twos", "more"), sums, strict=True)})
                rows = []
            elif level == 1:
                keys, counts = added(column("keys"), column("counts"))
                save(folder, f"{'words' if kind == WORDS else 'grams1'}-{part}", keys=keys, **_small(counts))
                rows = [_totals(0 if kind == WORDS else 1, counts)]
            else:
                rows = _merge_grams(folder, level, part, sent, parts)
        found = list(_rows(rows))
        return pa.Table.from_batches(found) if found else pa.table({n: pa.array([], k) for n, k in (("kind", pa.int32()), ("level", pa.int32()), ("part", pa.int64()), ("data", pa.binary()), ("totals", pa.list_(pa.int64())))})

    return run


def _merge_grams(folder: str, level: int, part: int, sent: list[dict[str, np.ndarray]], parts: int) -> list[tuple]:
    columns = [np.concatenate([np.repeat(x[f"context{k}"], x["runs"]) for x in sent]) for k in range(level - 1)]
    words = np.concatenate([x["words"][x["place"]] for x in sent])
    keys = gram_keys(columns[0], words, parts)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.add.reduceat(np.concatenate([x["counts"] for x in sent])[order].astype(np.int64), first)
    save(folder, f"grams{level}-{part}", keys=keys[first], **_small(counts))
    own = order[first]
    columns, words = [c[own] for c in columns], words[own]
    above, *sums = added(columns[0], counts, counts == 1, counts == 2, counts > 2)
    rows = [_totals(level, counts), *_gram_rows(columns[1:], words, parts)]
    for i, a, b in by_part(above, parts):
        rows.append((CONTEXTS, level, i, pack(keys=above[a:b], **{n: _narrow(x[a:b]) for n, x in zip(("total", "ones", "twos", "more"), sums, strict=True)}), None))
    return rows


@dataclass
class Level:
    """What is summed over all n-grams of a level; ``discounts`` are those of counts 1, 2 and more."""

    discounts: tuple[float, ...]
    total: int
    kinds: int
    more: tuple[int, int, int]

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *self.discounts])[np.minimum(counts, 3)], 0.0)

    def spared(self, ones, twos, more):
        return self.discounts[0] * ones + self.discounts[1] * twos + self.discounts[2] * more


def discounts(t: list[int]) -> tuple[float, ...]:
    """Discounts from how many counts are 1 to 4; PLAIN if one is missing or they fall outside 0 to their count."""
    if min(t) <= 0:
        return PLAIN
    y = t[0] / (t[0] + 2 * t[1])
    out = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3))
    return out if all(0 <= d <= k + 1 for k, d in enumerate(out)) else PLAIN


@dataclass
class NGrams:
    """A model in files. ``levels``: from 1 to ``order``; ``tokens`` and ``words``: all and distinct ones it has learnt from."""

    folder: str
    parts: int
    order: int
    tokens: int
    words: int
    levels: dict[int, Level]

    def _seek(self, name: str, keys: np.ndarray, fields: list[str]) -> list[np.ndarray]:
        """Numbers of sorted keys, 0 for unknown ones. ``fields`` are the file's columns; none are its counts."""
        out = [np.zeros(len(keys), np.float64 if fields else np.int64) for _ in fields or [0]]
        for i, a, b in by_part(keys, self.parts):
            arrays = load(self.folder, f"{name}-{i}")
            if arrays is not None:
                at, there = find(arrays["keys"], keys[a:b])
                hit = at[there]
                for x, values in zip(out, [arrays[f][hit] for f in fields] or [_counts(arrays, hit)], strict=True):
                    x[a:b][there] = values
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, and the sums of log10 of add-one and of Kneser-Ney probabilities."""
        word, bounds = tokens(data, offsets)
        kinds, place = np.unique(word, return_inverse=True)
        known, follows = self._seek("words", kinds, [])[0], self._seek("grams1", kinds, [])[0]
        level = self.levels[1]
        if level.total:
            p = (level.discounted(follows) + level.spared(*level.more) / (level.kinds + 1)) / level.total
        else:
            p = np.ones(len(kinds))
        p = p[place]
        for m, context in zip(range(2, self.order + 1), reversed(contexts(word, bounds, self.order)), strict=True):
            keys, own = np.unique(gram_keys(context, word, self.parts), return_inverse=True)
            count = self.levels[m].discounted(self._seek(f"grams{m}", keys, [])[0])[own]
            keys, own = np.unique(context, return_inverse=True)
            total, *more = self._seek(f"contexts{m}", keys, ["total", "ones", "twos", "more"])
            spared, total = self.levels[m].spared(*more)[own], total[own]
            p = np.where(total > 0, (count + spared * p) / np.maximum(total, 1), p)
        base = np.log10((known + 1) / (self.tokens + self.words + 1))[place]
        sums = [np.add.reduceat(x.astype(np.longdouble), bounds[:-1]).astype(np.float64) for x in (base, np.log10(p))]
        return np.diff(bounds), np.add.reduceat((known > 0)[place].astype(np.int64), bounds[:-1]), *sums


def fit_ngrams(docs: DataFrame, order: int = 2) -> NGrams:
    """A model of all texts of ``docs``, in files of the shared folder. Null texts are empty, and an empty table gives a model that knows nothing."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    parts, folder = shuffle_partitions(spark), new_folder(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, bounds = tokens(*utf8(block.column("text").chunk(0)))
            yield from _rows(_word_rows(WORDS, *distinct(words), parts))
            yield from _rows(_gram_rows(contexts(words, bounds, order), words, parts))

    rows = docs.select(whole_text().alias("text")).mapInArrow(tidy(count), MESSAGE)
    for _ in range(order):
        rows = rows.groupBy("kind", "level", "part").applyInArrow(_merge(folder, parts), MESSAGE)
    sums = {level: [0] * 7 for level in range(order + 1)}
    for row in rows.select("level", F.posexplode("totals")).groupBy("level", "pos").agg(F.sum("col").alias("n")).collect():
        sums[row.level][row.pos] = row.n
    levels = {m: Level(discounts(s[:4]), s[4], s[5], (s[0], s[1], s[5] - s[0] - s[1])) for m, s in sums.items() if m}
    return NGrams(folder, parts, order, sums[0][4], sums[0][5], levels)


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def score_texts(rows: DataFrame, model: NGrams, *keep: str) -> DataFrame:
    """The columns ``keep`` with the scores of ``text``, null being empty: its tokens with the end, how many of them
    the model has seen, the tokens it learnt from, log10 probabilities by add-one and by the model, and the perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, SCORE_BYTES):
            n, known, base, score = model.score(*utf8(block.column("text").chunk(0)))
            out = [n, known, np.full(len(n), model.tokens), np.round(base, 9), np.round(score, 9), 10.0 ** (-score / n)]
            table = block.drop_columns(["text"])
            for name, x in zip(("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"), out, strict=True):
                table = table.append_column(name, pa.array(x))
            yield from table.to_batches(max_chunksize=1 << 14)

    rows = rows.select(*keep, whole_text().alias("text"))
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(tidy(run), ", ".join([*kept, SCORES]))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id, as text, falls into the fold that is not learnt from; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def language_model_scores(docs: DataFrame, order: int = 2, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out and scores of every document under a model of those that are not held out.

    Null and empty texts are one end each; repeated rows are learnt from and
    scored as often as they are there; a null doc_id is not held out; an empty
    table gives an empty result, and where all are held out the model knows
    nothing. Further columns are ignored. A text is held whole by its task.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    return score_texts(rows, fit_ngrams(rows.where("not held_out"), order), "doc_id", "held_out")
