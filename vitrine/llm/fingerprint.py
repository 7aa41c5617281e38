"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted k smallest distinct 64-bit shingle hashes of a text.
Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_text
from .textbytes import Hasher, joined, shingles, slices, tidy, utf8, word_spans

K, WIDTH = 128, 5


def sketch_all(data: np.ndarray, offsets: np.ndarray, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """One sketch for each row of a text batch; empty for a text without words."""
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, bounds)
        values, at = shingles(Hasher(part).spans(start, end), row, b - a, width)
        for i in range(b - a):
            x = values[at[i] : at[i + 1]]
            if len(x) > 8 * k:  # distinct values are found among the smallest, or else among all
                small = np.unique(np.partition(x, 4 * k)[: 4 * k])
                x = small if len(small) >= k else x
            out.append(np.unique(x)[:k])
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / (float(sketch[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.append(True, ~twice)
    last = np.flatnonzero(first)[:k][-1]  # the k-th distinct value's first place
    return float(twice[: last + 1].sum() / min(k, int(first.sum())))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds ``fingerprint`` (base64) and ``distinct_shingles`` to doc_id; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketch_all(*utf8(batch.column(1)), k, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(encode, found), pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())],
                names=["doc_id", "fingerprint", "distinct_shingles"],
            )

    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(tidy(run), "doc_id bigint, fingerprint string, distinct_shingles double")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last third (by code points, rounded down) replaced
    by as many first code points of the next document in descending doc_id; the
    last document's next is the first. Documents are dealt out in ranges of
    doc_id whose bounds are existing ids; the document at a bound goes to its
    own range and, as the look-ahead, to the range before it, so that texts are
    shuffled once and read as a stream.

    Null text is empty; null ids come last; equal ids are ordered by text and
    each row is a document of its own; a lone document is its own next; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ranges = 8 * shuffle_partitions(spark)
    rows = docs.select("doc_id", whole_text().alias("text"))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges + 1)], 20 * ranges).alias("b")).first()["b"]
    bounds = np.unique(np.array(found or [], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Range r, from 0, holds the ids up to bounds[r]; null goes to range -1, the last in order."""
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            value = np.asarray(ids.fill_null(0), np.int64)
            span = np.where(known, np.minimum(np.searchsorted(bounds, value), len(bounds) - 1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(span, pa.int64()), pa.array(np.zeros(len(span), np.int8))], names=["doc_id", "text", "span", "ahead"])
            edge = np.flatnonzero(known & np.isin(value, bounds))
            if len(edge):
                before = span[edge] + 1
                wraps = np.where(before == len(bounds), -1, before)
                extra = batch.take(pa.array(edge))
                yield pa.RecordBatch.from_arrays([*extra.columns, pa.array(wraps, pa.int64()), pa.array(np.ones(len(edge), np.int8))], names=["doc_id", "text", "span", "ahead"])
                wrap = np.flatnonzero(before == len(bounds))
                if len(wrap):  # where no id is null, the range of the smallest ids is the last
                    extra = extra.take(pa.array(wrap))
                    yield pa.RecordBatch.from_arrays([*extra.columns, pa.array(np.zeros(len(wrap), np.int64)), pa.array(np.full(len(wrap), 2, np.int8))], names=["doc_id", "text", "span", "ahead"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next is not known yet, and the range's first row
        first = None

        def rows_of(done: list[tuple[tuple, str]]) -> pa.RecordBatch:
            texts = [r[1] for r, _ in done]
            edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for t, (_, nxt) in zip(texts, done, strict=True)]
            coded = [t.encode() for t in edited]
            own = sketch_all(*joined([t.encode() for t in texts]), k, width)
            other = sketch_all(*joined(coded), k, width)
            # a row's next is mostly the row after it, whose sketch is at hand
            after = [own[i + 1] if i + 1 < len(done) and texts[i + 1] == nxt else None for i, (_, nxt) in enumerate(done)]
            lack = [i for i, x in enumerate(after) if x is None]
            for i, x in zip(lack, sketch_all(*joined([done[i][1].encode() for i in lack]), k, width) if lack else [], strict=True):
                after[i] = x
            columns = [
                pa.array([r[0] for r, _ in done], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in coded], pa.string()),
                pa.array(map(encode, own), pa.string()),
                pa.array(map(encode, other), pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, other, strict=True)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, after, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        done: list[tuple[tuple, str]] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][2] != r[2]:  # no look-ahead came: the range is alone and starts anew
                    done.append((held.pop(), first[1]))
                if not r[3] and (first is None or first[2] != r[2]):
                    first = r
                if held:
                    done.append((held.pop(), r[1]))
                    size += len(r[1])
                if not r[3]:
                    held.append(r)
                if size > 1 << 20:
                    yield rows_of(done)
                    done, size = [], 0
        if held:
            done.append((held.pop(), first[1]))
        if done:
            yield rows_of(done)

    parts = shuffle_partitions(spark)
    dealt = rows.mapInArrow(tidy(deal), "doc_id bigint, text string, span bigint, ahead tinyint").repartition(parts, "span")
    return dealt.sortWithinPartitions("span", "ahead", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(tidy(finish), SCHEMA)
