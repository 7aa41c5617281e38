"""Exact top-k search: BM25 over inverted indexes with block-max WAND.

Documents are dealt into shards. Each shard has an inverted index whose posting
lists are cut into blocks that know their largest contribution; a query skips
every document and block that cannot reach the k-th score so far. Weights come
from statistics of the whole corpus, so shard results merge exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text
from .gather import gathered
from .textbytes import Hasher, folded, slices, tidy, utf8, word_spans

K1, B, BLOCK = 1.2, 0.75, 64
#: Documents and bytes of text from which a shard is closed.
SHARD_DOCS, SHARD_BYTES = 5000, 32 << 20
#: Bytes of query texts that the driver and each task hold at once, and the terms from which a query is scored whole.
QUERY_BYTES, LONG = 8 << 20, 64
#: Terms are runs of ASCII letters and digits and bytes of other characters, ASCII and Latin-1 capitals made small.
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term."""
    start, end, row = word_spans(data, offsets, _BREAK)
    return Hasher(folded(data)).spans(start, end), row


def impact(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """BM25's factor for a term's count in a document, without the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


@dataclass
class Postings:
    """One term's documents in order, their impacts, and the greatest impact of each block and of all."""

    docs: list[int]
    impacts: list[float]
    block_max: list[float]
    greatest: float


class Index:
    """Inverted index of one shard; documents are numbered in order of arrival."""

    def __init__(self, average: float):
        self.average = average
        self.codes, self.rows, self.counts = [], [], []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for a, b in slices(offsets):
            code, row = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            order = np.lexsort((row, code))
            code, row = code[order], row[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.empty(0, np.int64)
            self.codes.append(code[first])
            self.rows.append((row[first] + self.size).astype(np.int32))
            self.counts.append(np.diff(np.append(first, len(code))).astype(np.int32))
            self.lengths.append(np.bincount(row, minlength=b - a))
            self.size += b - a

    def close(self) -> None:
        """Posting lists of all terms, one after another."""
        code = np.concatenate([np.empty(0, np.uint64), *self.codes])
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.row = np.concatenate([np.empty(0, np.int32), *self.rows])[order]
        self.count = np.concatenate([np.empty(0, np.int32), *self.counts])[order]
        self.length = np.concatenate([np.empty(0, np.int64), *self.lengths])
        self.codes, self.rows, self.counts, self.lengths = [], [], [], []
        self.value = impact(self.count.astype(np.float64), self.length[self.row].astype(np.float64), self.average)

    def scored(self, codes: np.ndarray, weights: np.ndarray, k: int, ids: np.ndarray) -> list[tuple[float, int]]:
        """What ``wand`` returns, from the sums over all postings: bounds of many terms prune next to nothing."""
        total = np.zeros(self.size)
        for w, i, j in zip(weights, np.searchsorted(self.code, codes, "left"), np.searchsorted(self.code, codes, "right"), strict=True):
            total[self.row[i:j]] += w * self.value[i:j]
        total = np.round(total, 9)
        some = np.flatnonzero(total > 0)
        if len(some) > k:
            some = some[total[some] >= np.partition(total[some], len(some) - k)[len(some) - k]]
        some = some[np.lexsort((some, ids[some], -total[some]))[:k]]
        return [(float(total[n]), int(n)) for n in some]

    def postings(self, code: np.uint64) -> Postings | None:
        i, j = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        if i == j:
            return None
        docs = self.row[i:j]
        value = self.value[i:j]
        block = np.maximum.reduceat(value, np.arange(0, j - i, BLOCK))
        return Postings(docs.tolist(), value.tolist(), block.tolist(), float(value.max()))


def wand(lists: list[tuple[float, Postings]], k: int, ids: list[int]) -> list[tuple[float, int]]:
    """The k best (score, number), equal scores by lesser id. ``lists``: weight and postings of each query term.

    A document is scored only if the bounds of the lists up to it, and then of
    the blocks it is in, reach the k-th score; else all lists jump past it, and
    where the blocks fall short, past the end of the nearest block.
    """
    heap: list[tuple[float, int, int]] = []  # score, -id, number
    end = 1 << 62
    live = [[p.docs[0], 0, w, p, w * p.greatest] for w, p in lists]
    slack = 1e-9
    while live:
        live.sort(key=lambda x: x[0])
        least = heap[0][0] - slack if len(heap) == k else -1.0
        bound, pivot = 0.0, -1
        for i, cursor in enumerate(live):
            bound += cursor[4]
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            break
        target = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == target:
            pivot += 1
        bound, stop = 0.0, end
        for cursor in live[: pivot + 1]:
            docs, at = cursor[3].docs, cursor[1]
            block = at // BLOCK
            # the block that target would be in
            while (block + 1) * BLOCK < len(docs) and docs[min((block + 1) * BLOCK, len(docs)) - 1] < target:
                block += 1
            last = docs[min((block + 1) * BLOCK, len(docs)) - 1]
            if last >= target:
                bound += cursor[2] * cursor[3].block_max[block]
                stop = min(stop, last + 1)
        if bound >= least:
            score = 0.0
            for cursor in live[: pivot + 1]:
                _forward(cursor, target)
                if cursor[0] == target:
                    score += cursor[2] * cursor[3].impacts[cursor[1]]
                    _forward(cursor, target + 1)
            score = round(score, 9)
            item = (score, -ids[target], target)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        else:
            if pivot + 1 < len(live):
                stop = min(stop, live[pivot + 1][0])
            stop = max(stop, target + 1)
            for cursor in live[: pivot + 1]:
                _forward(cursor, stop)
        live = [c for c in live if c[0] < end]
    return [(s, n) for s, _, n in sorted(heap, reverse=True)]


def _forward(cursor: list, target: int) -> None:
    """Moves to the first document from ``target`` on, by doubling steps and halving."""
    docs, at = cursor[3].docs, cursor[1]
    if cursor[0] >= target:
        return
    step, n = 1, len(docs)
    while at + step < n and docs[at + step] < target:
        at += step
        step *= 2
    low, high = at + 1, min(at + step, n)
    while low < high:
        middle = (low + high) // 2
        if docs[middle] < target:
            low = middle + 1
        else:
            high = middle
    cursor[1] = low
    cursor[0] = docs[low] if low < n else 1 << 62


def _hits(texts: DataFrame, queries: list, k: int, shard_docs: int, shard_bytes: int) -> DataFrame:
    """query_id, doc_id and score of the k best of each shard for a block of queries."""
    asked = []
    for row in queries:
        raw = row.text.encode()
        code, _ = terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        asked.append((row.query_id, *np.unique(code, return_counts=True)))
    vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(c for _, c, _ in asked)]))

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, offsets = utf8(batch.column(0))
        total[0] += len(offsets) - 1
        for a, b in slices(offsets):
            code, row = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total[1] += len(code)
            if len(vocabulary) and len(code):
                place = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
                hit = vocabulary[place] == code
                pair = np.unique(place[hit] * (b - a) + row[hit])
                total[2 : 2 + len(vocabulary)] += np.bincount(pair // (b - a), minlength=len(vocabulary))

    total = gathered(texts.select("text"), add, 2 + len(vocabulary))
    n, average = int(total[0]), max(1.0, int(total[1]) / max(1, int(total[0])))
    weight = np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in total[2:].tolist()])
    asked = [(q, codes, weight[np.searchsorted(vocabulary, codes)] * times) for q, codes, times in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = Index(average), []

        def found() -> pa.RecordBatch:
            index.close()
            out, rank = [], [-1 << 62 if x is None else x for x in ids]
            ranks = np.array(rank, np.int64)
            for query_id, codes, weights in asked:
                if len(codes) >= LONG:
                    best = index.scored(codes, weights, k, ranks)
                else:
                    best = wand([(w, p) for c, w in zip(codes, weights.tolist(), strict=True) if (p := index.postings(c)) is not None], k, rank)
                out += [(query_id, ids[number], score) for score, number in best]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "doc_id", "score"])

        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, shard_docs):
                part = batch.slice(i, shard_docs)
                data, offsets = utf8(part.column(1))
                for a, b in slices(offsets, shard_bytes):
                    index.add(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ids += part.column(0)[a:b].to_pylist()
                    held += int(offsets[b] - offsets[a])
                    if len(ids) >= shard_docs or held >= shard_bytes:
                        yield found()
                        index, ids, held = Index(average), [], 0
        if ids:
            yield found()

    return texts.mapInArrow(tidy(run), "query_id bigint, doc_id bigint, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, doc_id and score of the k best documents of every query.

    ``queries``: query_id and text, of any number; they are asked in blocks of about
    QUERY_BYTES, so the driver and the tasks hold one block at a time. BM25 with k1 = 1.2 and b = 0.75, weight
    ln(1 + (N - df + 0.5) / (df + 0.5)), a query term counting as often as the
    query has it. Scores are rounded to 6 places and ranked by score, then
    doc_id; documents without a query term are not results.

    Null text is empty but counts in N; a null query finds nothing; null ids
    rank as the least; repeated rows are results each; empty tables give empty
    results; further columns are ignored. A shard ends at ``shard_docs`` documents
    or ``shard_bytes`` of text, so its index is of bounded size but for one text longer than that.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    asked = staged(queries.select(F.col("query_id").cast("long").alias("query_id"), whole_text().alias("text")))
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // QUERY_BYTES)
    own = F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks))
    hits = [_hits(texts, asked.where(own == i).collect(), k, shard_docs, shard_bytes) for i in range(max(1, blocks))]
    hits = reduce(DataFrame.union, hits)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))
