"""Approximate nearest vectors by layered graphs.

Vectors are dealt into shards of bounded size. In a shard each vector is linked
to near ones in different directions, and a random part of them again among
themselves, in ever thinner layers. A search goes down the layers, each time
from the best vector above, and at the bottom follows links from a beam of the
best so far until none of them leads to a better one. A shard is one row of a
table, so a search shuffles queries' hits and nothing of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import _queries, usable
from .ranking import top_k

#: Vectors of a shard on average, links of a vector, and how much thinner each layer is.
SHARD, LINKS, THINNER = 1 << 14, 12, 32
#: Queries that walk a shard together, and rows of similarities at once.
TOGETHER, ROWS = 256, 1024
GRAPH = "shard int, keys binary, vectors binary, layers array<struct<inside: binary, links: binary>>"


def _linked(x: np.ndarray, links: int) -> np.ndarray:
    """For each unit vector the places of up to ``links`` others, -1 where there are fewer.

    Of its nearest, one is taken unless it is nearer to one already taken than to
    the vector itself; the nearest of the rest fill up. Links then go both ways,
    the nearest first.
    """
    n, wide = len(x), min(len(x) - 1, 3 * links)
    out = np.full((n, links), -1, np.int32)
    if wide <= 0:
        return out
    for a in range(0, n, ROWS):
        near = x[a : a + ROWS] @ x.T
        rows = np.arange(len(near))
        near[rows, a + rows] = -np.inf
        some = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        size = np.take_along_axis(near, some, 1)
        order = np.lexsort((some, -size), axis=1)
        some, size = np.take_along_axis(some, order, 1), np.take_along_axis(size, order, 1)
        among = np.einsum("rid,rjd->rij", x[some], x[some])
        taken = np.zeros(some.shape, bool)
        for j in range(wide):
            covered = (taken[:, :j] & (among[:, j, :j] > size[:, j, None])).any(axis=1)
            taken[:, j] = ~covered & (taken[:, :j].sum(axis=1) < links)
        first = np.argsort(~taken, axis=1, kind="stable")[:, :links]
        out[a : a + ROWS, : first.shape[1]] = np.take_along_axis(some, first, 1)
    return _both_ways(x, out, 2 * links)


def _both_ways(x: np.ndarray, out: np.ndarray, most: int) -> np.ndarray:
    """Links with those that lead back, up to ``most`` nearest of each vector."""
    here, there = np.repeat(np.arange(len(out)), out.shape[1]), out.ravel()
    some = there >= 0
    pair = np.unique(np.concatenate([here[some] * len(out) + there[some], there[some] * len(out) + here[some]]))
    here, there = pair // len(out), pair % len(out)
    order = np.lexsort((there, -np.einsum("pd,pd->p", x[here], x[there]), here))
    here, there = here[order], there[order]
    place = np.arange(len(here)) - np.searchsorted(here, here)
    both = np.full((len(out), most), -1, np.int32)
    both[here[place < most], place[place < most]] = there[place < most]
    return both


def build_graph(vectors: DataFrame, shard: int = SHARD, links: int = LINKS, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """A row for each shard: keys and unit vectors in order of key, and of each layer, the first of which holds all,
    the places of its vectors and of their links. Best written by ``write_graph``. Null and all-zero vectors are left
    out; equal keys are vectors each."""
    rows = usable(vectors, column).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        x = np.stack(frame.vector.to_numpy())
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        rank = np.random.default_rng(len(x)).permutation(len(x))
        layers, inside = [], np.arange(len(x), dtype=np.int32)
        while len(inside):
            found = _linked(x[inside], links)
            layers.append({"inside": inside.tobytes(), "links": np.where(found >= 0, inside[found], -1).astype(np.int32).tobytes()})
            inside = np.flatnonzero(rank < len(x) // THINNER ** len(layers)).astype(np.int32)
        return pd.DataFrame({"shard": [frame.shard.iloc[0]], "keys": [frame.key.to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "layers": [layers]})

    return dealt.groupBy("shard").applyInPandas(run, GRAPH)


def write_graph(graph: DataFrame, path: str) -> None:
    """One file a shard, so that a reader holds few at a time."""
    graph.write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(path)


class Layers:
    """The graph of one shard in arrays."""

    def __init__(self, keys: bytes, vectors: bytes, layers: list):
        self.keys = np.frombuffer(keys, np.int64)
        self.x = np.frombuffer(vectors, np.float32).reshape(len(self.keys), -1)
        self.layers = []
        for layer in layers:
            inside = np.frombuffer(layer["inside"], np.int32)
            self.layers.append((inside, np.frombuffer(layer["links"], np.int32).reshape(len(inside), -1)))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and similarities of the ``beam`` best that unit vectors meet, best first, and how many each was compared with."""
        inside, _ = self.layers[-1]
        near = q @ self.x[inside].T
        start, seen = inside[near.argmax(axis=1)], np.full(len(q), len(inside))
        for inside, links in reversed(self.layers[1:-1]):
            place, _, n = self._walk(q, start, inside, links, 4)
            start, seen = place[:, 0], seen + n
        place, size, n = self._walk(q, start, *self.layers[0], beam)
        return place, size, seen + n

    def _walk(self, q: np.ndarray, start: np.ndarray, inside: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All queries a step at a time: the best of each beam that has not been left yet is left by all its links."""
        n, rows = len(q), np.arange(len(q))
        row_of = np.zeros(len(self.keys), np.int32)
        row_of[inside] = np.arange(len(inside))
        met = np.zeros((n, len(self.keys) + 1), bool)
        met[:, -1] = True
        met[rows, start] = True
        place = np.full((n, beam), -1, np.int64)
        size = np.full((n, beam), -np.inf, np.float32)
        left = np.ones((n, beam), bool)
        place[:, 0], size[:, 0], left[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start]), False
        compared, going = np.ones(n, np.int64), rows
        while len(going):
            best = np.where(left[going], -np.inf, size[going]).argmax(axis=1)
            going, best = going[~left[going, best]], best[~left[going, best]]
            if not len(going):
                break
            left[going, best] = True
            ends = links[row_of[place[going, best]]]
            fresh = ~met[going[:, None], ends]
            met[going[:, None], ends] = True
            compared[going] += fresh.sum(axis=1)
            near = np.einsum("nd,nld->nl", q[going], self.x[ends])
            near[~fresh] = -np.inf
            all_size, all_place = np.concatenate([size[going], near], axis=1), np.concatenate([place[going], ends], axis=1)
            all_left = np.concatenate([left[going], ~fresh], axis=1)
            keep = np.argpartition(-all_size, beam - 1, axis=1)[:, :beam]
            size[going], place[going], left[going] = (np.take_along_axis(a, keep, 1) for a in (all_size, all_place, all_left))
        order = np.argsort(-size, axis=1, kind="stable")
        return np.take_along_axis(place, order, 1), np.take_along_axis(size, order, 1), compared


def knn_graph(graph: DataFrame, queries: DataFrame, k: int, beam: int = 24, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """query_id, key, score, rank and compared: about the k nearest by the graphs of ``build_graph``.

    ``beam``, k at least, is how many a walk keeps in each shard; recall and work
    grow with it. ``compared`` is how many vectors of all shards the query was
    compared with. Queries are sent to the shards in blocks; each shard passes on
    its k best, compared anew in double precision. ``knn_exact`` is the exact way.
    """
    beam = max(beam, k)
    hits = []
    for ids, _, unit in _queries(queries):

        def run(frames: Iterator[pd.DataFrame], ids=np.array(ids, np.int64), unit=unit) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for keys, vectors, layers in zip(frame["keys"], frame.vectors, frame.layers, strict=True):
                    shard = Layers(keys, vectors, layers)
                    for a in range(0, len(ids), TOGETHER):
                        yield _best(shard, ids[a : a + TOGETHER], unit[a : a + TOGETHER], k, beam, key, digits)

        hits.append(graph.select("keys", "vectors", "layers").mapInPandas(run, f"query_id long, {key} long, score double, seen long"))
    found = reduce(DataFrame.union, hits)
    every = found.groupBy("query_id").agg(F.sum(F.when(F.col(key).isNull(), F.col("seen"))).alias("compared"))
    return top_k(found.where(F.col(key).isNotNull()).drop("seen"), k, key=key).join(every, "query_id")


def _best(shard: Layers, ids: np.ndarray, unit: np.ndarray, k: int, beam: int, key: str, digits: int) -> pd.DataFrame:
    """The k best of a shard for some queries, and a row without a key of how many vectors each was compared with."""
    place, size, seen = shard.search(unit.astype(np.float32), beam)
    x = shard.x[place].astype(np.float64)
    near = np.round(np.einsum("nd,nbd->nb", unit, x / np.linalg.norm(x, axis=-1, keepdims=True)), digits)
    near = np.where(size > -np.inf, near, -np.inf)
    order = np.lexsort((shard.keys[place], -near), axis=1)[:, :k]
    place, near = np.take_along_axis(place, order, 1), np.take_along_axis(near, order, 1)
    some = near > -np.inf
    found = pd.DataFrame({"query_id": np.repeat(ids, some.sum(axis=1)), key: pd.array(shard.keys[place][some], "Int64"), "score": near[some], "seen": 0})
    return pd.concat([found, pd.DataFrame({"query_id": ids, key: pd.array([None] * len(ids), "Int64"), "score": 0.0, "seen": seen})])
