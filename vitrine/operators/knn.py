"""Nearest vectors by cosine: exact, by inverted file, and by hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.vectors import matrix, nearest_codeword, norm
from .index import Index, dense, query_weights
from .ranking import EVERY, top_k

#: Queries that meet the vectors at once; more are asked in blocks of about as many.
MOST_QUERIES = 10_000
#: Similarities that a task holds at once, and queries whose answers by signatures are passed on together.
TILE, TOGETHER = 1 << 21, 256


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor all zero."""
    return vectors.where(F.col(column).isNotNull()).where(norm(F.col(column)) > 0)


def _queries(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, vectors and unit vectors of the queries, a block at a time."""
    asked = usable(queries, "vector").select("query_id", "vector")
    rows = asked.limit(MOST_QUERIES + 1).collect()
    blocks = -(-asked.count() // MOST_QUERIES) if len(rows) > MOST_QUERIES else 1
    own = F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks))
    for i in range(blocks):
        part = rows if blocks == 1 else asked.where(own == i).collect()
        x = matrix([r.vector for r in part])
        yield [r.query_id for r in part], x, x / np.linalg.norm(x, axis=1, keepdims=True) if len(part) else x


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int | None, key: str = "doc_id", column: str = "embedding", digits: int = 6, apart: bool = True) -> DataFrame:
    """query_id, key, score and rank of the k nearest of all vectors, or of all of them without a k.

    Each task multiplies its vectors by the matrix of queries, a block of them at
    a time, and passes on its k best for each query; of the products it holds a
    tile at once, however many queries and vectors there are. Without ``apart``
    only vectors of positive cosine count.
    """
    known = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).alias("vector"))
    hits = [_nearest(known, ids, q, k, key, digits, apart) for ids, _, q in _queries(queries)]
    return top_k(reduce(DataFrame.union, hits), k if k is not None else EVERY, key=key)


def _best(ids: np.ndarray, unit: np.ndarray, frame: pd.DataFrame, k: int | None, key: str, digits: int, apart: bool = True) -> Iterator[pd.DataFrame]:
    """The k rows of the frame nearest to each unit vector, equals by lesser key, a tile of queries at a time."""
    x = np.stack(frame.vector.to_numpy()).astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    x, own = x[size > 0] / size[size > 0, None], frame[key].to_numpy()[size > 0]
    if not len(x):
        return
    step = max(1, TILE // len(x))
    for a in range(0, len(ids), step):
        raw = unit[a : a + step] @ x.T
        near = np.round(raw, digits)
        some = np.ones(near.shape, bool) if apart else raw > 0
        if k is not None and k < len(x):
            some &= near >= np.partition(near, len(x) - k, axis=1)[:, len(x) - k, None]
        row, place = np.nonzero(some)
        score = near[row, place]
        order = np.lexsort((own[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        if k is not None:
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, place, score = row[first], place[first], score[first]
        yield pd.DataFrame({"query_id": ids[a + row], key: own[place], "score": score})


def _nearest(known: DataFrame, ids: list, q: np.ndarray, k: int | None, key: str, digits: int, apart: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame], ids=np.array(ids, np.int64)) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and len(ids):
                yield from _best(ids, q, frame, k, key, digits, apart)

    return known.mapInPandas(run, f"query_id long, {key} long, score double")


def nearest_histograms(index: Index, query_tf: DataFrame, size: int, k: int, digits: int = 6) -> DataFrame:
    """The rows of ``top_k(score(index, query_tf), k)`` for codewords from 0 to ``size`` - 1, a codebook of some hundreds.

    Nearly all documents share one of so few codewords with a query, so histograms
    are multiplied as they are, in tiles, and no row is made of a pair that is not
    among the k best of a task. Weights are not negative: those that share a
    codeword of weight have a positive cosine, and others none.
    """
    weights = query_weights(query_tf, index.idf, index.codeword).withColumnRenamed("query_weight", "tf")
    asked = dense(weights, size, "query_id", index.codeword, "double").withColumnRenamed("histogram", "vector")
    known = dense(index.postings.select("doc_id", index.codeword, F.col("weight").alias("tf")), size, "doc_id", index.codeword, "double")
    return knn_exact(known, asked, k, column="histogram", digits=digits, apart=False)


def assign_lists(vectors: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """Adds ``list_id``, the nearest centre: the inverted file's partition of a vector."""
    return vectors.withColumn("list_id", nearest_codeword(F.col(column), centres))


def knn_ivf(lists: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int = 1, key: str = "doc_id", column: str = "embedding", digits: int = 6) -> DataFrame:
    """The k nearest among the ``probes`` lists nearest to each query. ``lists`` comes from ``assign_lists``,
    best written partitioned by list_id, so that lists not probed are not read. Each task multiplies the
    vectors of a list by the queries that probe it, a block of queries at a time."""
    known = usable(lists, column).select(F.col(key).cast("long").alias(key), F.col(column).alias("vector"), "list_id")
    hits = []
    for ids, raw, unit in _queries(queries):
        far = np.round((centres**2).sum(axis=1) - 2 * raw @ centres.T, 9) if len(ids) else np.empty((0, len(centres)))
        probed = np.argsort(far, axis=1, kind="stable")[:, :probes]
        of_list = {int(n): np.flatnonzero((probed == n).any(axis=1)) for n in np.unique(probed)}

        def run(frames: Iterator[pd.DataFrame], ids=np.array(ids, np.int64), unit=unit, of_list=of_list) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for number, rows in frame.groupby("list_id"):
                    asked = of_list.get(int(number))
                    if asked is not None:
                        yield from _best(ids[asked], unit[asked], rows, k, key, digits)

        hits.append(known.where(F.col("list_id").isin(sorted(of_list))).mapInPandas(run, f"query_id long, {key} long, score double"))
    return top_k(reduce(DataFrame.union, hits), k, key=key)


def with_signatures(vectors: DataFrame, bits: int = 512, seed: int = 42, column: str = "embedding") -> DataFrame:
    """Adds ``signature``: on which side of ``bits`` random planes a vector is. Rows without a usable vector go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sides = np.packbits(np.stack(frame[column].to_numpy()).astype(np.float64) @ _planes(len(frame[column].iloc[0]), bits, seed) > 0, axis=1)
                yield frame.assign(signature=[r.tobytes() for r in sides])

    rows = usable(vectors, column)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("signature", BinaryType())]))


def _planes(size: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, bits))


def knn_lsh(signed: DataFrame, queries: DataFrame, k: int, candidates: int = 400, seed: int = 42, key: str = "doc_id", column: str = "embedding", digits: int = 6) -> DataFrame:
    """About the k nearest, by random-plane hashing: of each part of the rows of ``with_signatures``, the
    ``candidates`` of nearest signatures are compared in full. Recall falls with rows per part over candidates."""
    known = signed.select(F.col(key).cast("long").alias(key), F.col(column).alias("vector"), "signature")
    schema = f"query_id long, {key} long, score double"
    hits = []
    for ids, _, q in _queries(queries):

        def run(frames: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame) or not len(ids):
                    continue
                rows = np.frombuffer(b"".join(frame.signature), np.uint64).reshape(len(frame), -1)
                asked = np.packbits(q @ _planes(q.shape[1], rows.shape[1] * 64, seed) > 0, axis=1).view(np.uint64)
                x, own = np.stack(frame.vector.to_numpy()).astype(np.float64), frame[key].to_numpy()
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = []
                for i, query_id in enumerate(ids):
                    far = np.bitwise_count(rows ^ asked[i]).sum(axis=1, dtype=np.int64)
                    some = np.argpartition(far, candidates)[:candidates] if len(far) > candidates else np.arange(len(far))
                    near = np.round(x[some] @ q[i], digits)
                    best = some[np.lexsort((own[some], -near))[:k]]
                    found.append((np.full(len(best), query_id), own[best], np.round(x[best] @ q[i], digits)))
                    if len(found) == TOGETHER or i + 1 == len(ids):
                        yield pd.DataFrame(dict(zip(("query_id", key, "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
                        found = []

        hits.append(known.mapInPandas(run, schema))
    return top_k(reduce(DataFrame.union, hits), k, key=key)
