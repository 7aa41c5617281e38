"""Quality classifier: pooled random-indexing vectors and a two-layer network.

Every token has a random sparse index vector. A word's vector is the sum of the
index vectors of the tokens around it over the whole corpus. A document is
pooled to the mean of its words' vectors and the mean of its tokens' shapes, and
a small numpy network gives the probability of a good document, its temperature
set on rows that it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .gather import gathered
from .textbytes import Hasher, U, row_bounds, slices, tidy, utf8

WORDS, SHAPES, DIM, REACH = 8192, 128, 32, 2
_CASE = np.arange(256, dtype=np.uint8)
_CASE[0x41:0x5B] += 32
_KIND = np.full(256, 3, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[range(0x30, 0x3A)] = 2
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def index_vectors(n: int, dim: int, seed: int, filled: int = 4) -> np.ndarray:
    """Sparse ternary vectors: ``filled`` places of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.int32)
    place = rng.random((n, dim)).argsort(axis=1)[:, :filled]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int32), (n, filled)), 1)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, shape and row of every token: a run of letters, digits or signs."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    kind = _KIND[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    fresh[1:n] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(fresh)
    cut = cut if cut[-1] == n else np.append(cut, n)
    start, end = cut[:-1], cut[1:]
    real = (kind[np.minimum(start, n - 1)] != 0) & (start < end)
    start, end = start[real], end[real]
    row = np.searchsorted(offsets, start, "right") - 1
    hashes = Hasher(_CASE[data]).spans(start, end)
    upper = np.append(0, np.cumsum(_UPPER[data]))
    capitals, size, what = upper[end] - upper[start], end - start, kind[start]
    case = np.where((capitals > 1) & (2 * capitals > size), 2, np.where(_UPPER[data[start]], 1, 0))
    long = np.searchsorted([2, 4, 7, 11], size, "right")
    again = np.zeros(len(start), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    signs = 35 + (hashes % U(SHAPES - 35)).astype(np.int64)
    shape = np.where(what == 1, case * 10 + long * 2 + again, np.where(what == 2, 30 + long, signs))
    return (hashes >> U(51)).astype(np.int64), shape, row


def _around(vectors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token the sum of the vectors up to ``REACH`` places away in its row."""
    out = np.zeros_like(vectors)
    for d in range(1, REACH + 1):
        same = (row[d:] == row[:-d])[:, None]
        out[d:] += vectors[:-d] * same
        out[:-d] += vectors[d:] * same
    return out


def train_vectors(texts: DataFrame, seed: int = 1) -> np.ndarray:
    """Unit word vectors (WORDS x DIM) from all texts."""
    words, shapes = index_vectors(WORDS, DIM, seed), index_vectors(SHAPES, DIM, seed + 1)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, offsets = utf8(batch.column("text"))
        total = total.reshape(WORDS, DIM)
        for a, b in slices(offsets, 1 << 19):
            word, shape, row = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(word):
                continue
            near = _around(words[word] + shapes[shape], row)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(word[order]) > 0))
            total[word[order][first]] += np.add.reduceat(near[order], first, axis=0)

    total = gathered(texts.select("text"), add, WORDS * DIM).reshape(WORDS, DIM).astype(np.float64)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One feature row for each text; zeros for one without tokens."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM + SHAPES + 1), np.float32)
    for a, b in slices(offsets, 1 << 19):
        word, shape, row = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if not len(word):
            continue
        bounds = row_bounds(row, b - a)
        count = np.diff(bounds)
        some = np.flatnonzero(count)
        mean = np.add.reduceat(vectors[word], bounds[:-1][some], axis=0) / count[some, None]
        share = np.bincount(row * SHAPES + shape, minlength=(b - a) * SHAPES).reshape(b - a, SHAPES)[some] / count[some, None]
        out[a + some, :DIM], out[a + some, DIM:-1], out[a + some, -1] = mean, np.sqrt(share), np.log1p(count[some])
    return out


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, a logistic output with temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7, decay: float = 1e-3) -> Network:
    """Adam on four fifths of the rows; the temperature of least loss on the others.

    Without rows of both classes the score is their mean, or a half.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    spread = x[fit].std(axis=0)
    net = Network(x[fit].mean(axis=0), np.where(spread > 1e-6, spread, 1.0), rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x[fit] - net.centre) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 256)):
            zi, yi = z[rows], y[fit][rows]
            h = np.maximum(zi @ weights[0] + weights[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40)))
            d = (p - yi) / len(rows)
            dh = np.outer(d, weights[2]) * (h > 0)
            grads = [zi.T @ dh + decay * weights[0], dh.sum(0), h.T @ d + decay * weights[2], np.array([d.sum()])]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 2e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(held):
        logit, sign = net.logits(x[held]), 2 * y[held] - 1
        grid = np.geomspace(0.25, 8, 60)
        net.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid])])
    return net


def held_out(doc_id, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    """doc_id, text and y of labelled documents. Contradictory labels of one id cancel out.

    Of about ``sample`` ids at most, those of least hash, so what is sent to the
    tasks is of bounded size, texts stay where they are, and the plan is one
    and the same at any size.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("y")).where("y != 0.5")
    known = known.select("doc_id", F.round("y").cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known if share == 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and a network fitted on at most ``sample`` labelled rows."""
    vectors = train_vectors(docs.select(whole_text().alias("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*utf8(batch.column(1)), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", sample).mapInArrow(tidy(features), "doc_id bigint, y int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), DIM + SHAPES + 1)
    return vectors, fit_network(x, np.array([r.y for r in rows], np.int64))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], *keep: str) -> DataFrame:
    """Adds ``score``, the probability of a good document, to the columns ``keep``; null text counts as empty."""
    vectors, net = model
    rows = docs.select(*keep, whole_text().alias("_text"))
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = net.score(pooled(*utf8(batch.column(len(keep))), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(tidy(run), schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learnt only from ids outside the held-out fold. Null and repeated
    ids are scored as any row; a table without usable labels scores a half; an
    empty table gives an empty result; further columns are ignored.
    """
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    return score_quality(docs, model, "doc_id").select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
