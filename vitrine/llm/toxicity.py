"""Toxicity scores behind a noisy-channel deobfuscator.

Words that look disguised (digits or signs for letters, separators or spaces
between letters, stretched letters) are restored by Viterbi decoding of a
lattice of what each character may stand for, under a character trigram model
of the corpus. The restored text is scored by word and word-beginning evidence
learnt from labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .gather import gathered
from .quality import held_out, labelled
from .textbytes import Hasher, U, joined, slices, tidy, utf8, word_spans

# --- fixed values: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
WILD = "*#"
SEPARATORS = " .-_~·"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

SYMBOLS = 64
FEATURES = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
REMEMBERED = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SUBSTITUTE = np.zeros(256, bool)
_SUBSTITUTE[[ord(c) for c in LEET if ord(c) < 128] + [ord(c) for c in WILD]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[range(0x30, 0x3A)] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS if ord(c) < 128]] = True
#: 0 is a word's edge; letters 1 to 26; the bytes of other letters share the rest.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:0x100] = 27 + np.arange(128) % 37


def _letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, ~_LETTER)


def language_model(texts: DataFrame) -> np.ndarray:
    """Log probability of each byte after the two before it, from every word of the corpus."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, offsets = utf8(batch.column(0))
        for a, b in slices(offsets, 1 << 20):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not len(part):
                continue
            symbol = np.zeros(len(part) + 2 * (b - a) + 2, np.int64)  # edges between rows
            symbol[np.arange(len(part)) + 2 * np.repeat(np.arange(b - a), np.diff(bounds)) + 2] = _SYMBOL[part]
            code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
            code = code[(symbol[1:-1] > 0) | (symbol[2:] > 0)]
            total += np.bincount(code, minlength=SYMBOLS**3)

    count = gathered(texts, add, SYMBOLS**3).reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    pairs, singles = count.sum(axis=0), count.sum(axis=(0, 1))
    one = (singles + 1) / (singles.sum() + SYMBOLS)
    two = (pairs + 8 * one) / (pairs.sum(axis=1, keepdims=True) + 8)
    three = (count + 4 * two) / (count.sum(axis=2, keepdims=True) + 4)
    return np.log(three)


def _choices(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, each with its channel cost; '' drops it, ' ' ends a word."""
    out: list[list[tuple[str, float]]] = []
    runs = [m.group() for m in re.finditer(r"(.)\1*", token, re.S)]
    for run in runs:
        c, n = run[0], len(run)
        if c in SEPARATORS:
            out.append([("", 0.5), (" ", 2.0)])
        elif c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, 8.0 if n == 2 else 1.0), (c * 2, 0.0 if n == 2 else 1.0)])
        elif c in WILD:
            out.append([(x, 3.0) for x in LETTERS] + [("", 6.0)])
        elif c in LEET:
            stands = [(x, 0.5) for x in LEET[c]]
            out.append(stands + ([(x * 2, 1.0) for x in LEET[c]] if n > 1 else []) + [("", 12.0)])
        else:
            out.append([("", 1.0)])
    return out


def decode(token: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind a disguised token of any length: Viterbi over the lattice, states being the last two symbols."""
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for choices in [*_choices(token.lower()), [(" ", 0.0)]]:
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (p, q), cost in states.items():
            for emitted, channel in choices:
                total, x, y = cost + channel, p, q
                for byte in b"\0" if emitted == " " else emitted.encode():
                    s = int(_SYMBOL[byte]) if byte else 0
                    if s or y:  # one edge at most between words
                        total -= float(model[x, y, s])
                        x, y = (0, 0) if s == 0 else (y, s)
                if (x, y) not in after or after[x, y] > total:
                    after[x, y], came[x, y] = total, ((p, q), emitted)
        states = after
        steps.append(came)
    state = min(states, key=lambda k: (states[k], k))
    parts = []
    for came in reversed(steps):
        state, emitted = came[state]
        parts.append(emitted)
    return "".join(reversed(parts)).split()


def disguised(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
    """Row and bytes of every word, or run of single characters, that may hide another word."""
    start, end, row = word_spans(data, offsets)
    if not len(start):
        return []
    letter, substitute, separator = _LETTER[data], _SUBSTITUTE[data], _SEPARATOR[data]
    n = len(data)
    odd, low = np.zeros(n + 1, bool), _LOWER[data]
    on = np.ones(n + 1, bool)  # the byte before is of the same row
    on[offsets] = False
    on = on[1:n]
    odd[: n - 1] |= substitute[:-1] & letter[1:] & on
    odd[1:n] |= (_DIGIT[data[1:]] | (data[1:] == 0x40)) & letter[:-1] & on
    if n > 2:
        odd[: n - 2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & on[:-1] & on[1:]
    if n > 3:
        odd[1 : n - 2] |= letter[:-3] & separator[1:-2] & letter[2:-1] & separator[3:] & on[:-2] & on[1:-1] & on[2:]
    seen = np.append(0, np.cumsum(odd[:n]))
    size = end - start
    found = [(int(row[i]), data[start[i] : end[i]].tobytes()) for i in np.flatnonzero(seen[end] > seen[start])]
    # single characters with one space after each
    inside = data[start]
    single = (size == 1) | ((size == 2) & (inside >= 0xC2) & (inside <= 0xDF))
    chain = np.append(False, single[1:] & single[:-1] & (row[1:] == row[:-1]) & (start[1:] == end[:-1] + 1))
    head = np.flatnonzero(single & ~chain)
    tail = np.flatnonzero(single & ~np.append(chain[1:], False))
    for i, j in zip(head, tail, strict=True):
        if j - i >= 3 and len(set(inside[i : j + 1].tolist())) > 1:
            found.append((int(row[i]), data[start[i] : end[j]].tobytes()))
    return found


class Restorer:
    """Decodes disguised tokens, each distinct short one once while it is remembered."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def __call__(self, token: bytes) -> list[str]:
        words = self.known.get(token)
        if words is None:
            if len(self.known) > 100_000:
                self.known.clear()
            text = re.sub(r"^[\"'\[{<,;:]+|[\"'\]}>,;:.?!%&*#|=]+$", "", token.decode())
            words = decode(text, self.model) if any(c.isalpha() or c in LEET for c in text) else []
            if len(token) <= REMEMBERED:
                self.known[token] = words
        return words


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row, and feature numbers (words x features; -1 for none), of every run of letters."""
    data = _LOWER[data]
    start, end, row = _letter_words(data, offsets)
    if not len(start):
        return row, np.empty((0, len(PREFIXES) + 1), np.int64)
    hasher = Hasher(data)
    columns = [(hasher.spans(start, end) >> U(46)).astype(np.int64)]
    for length in PREFIXES:
        long = end - start > length
        code = (hasher.spans(start, np.minimum(start + length, end)) * U(0x9E3779B97F4A7C15) >> U(46)).astype(np.int64)
        columns.append(np.where(long, code, -1))
    return row, np.stack(columns, axis=1)


def all_features(data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text's own words and of the restored ones."""
    row, code = word_features(data, offsets)
    extra: dict[int, list[str]] = {}
    for r, token in disguised(data, offsets):
        extra.setdefault(r, []).extend(restore(token))
    if not extra:
        return row, code
    rows = sorted(extra)
    more_row, more = word_features(*joined([" ".join(extra[r]).encode() for r in rows]))
    return np.concatenate([row, np.array(rows, np.int64)[more_row]]), np.concatenate([code, more])


def word_counts(rows: DataFrame, model: np.ndarray) -> np.ndarray:
    """For each half of the labelled rows the clean and toxic documents that have each feature, and of all, last."""
    restore = Restorer(model)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, offsets = utf8(batch.column("text"))
        kind = np.asarray(batch.column("y"), np.int64) + 2 * np.asarray(batch.column("half"), np.int64)
        for a, b in slices(offsets, 1 << 19):
            row, code = all_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], restore)
            pair = (np.repeat(row, code.shape[1]) * FEATURES + code.ravel())[code.ravel() >= 0]
            pair = np.unique(pair)
            total[: 4 * FEATURES] += np.bincount(kind[a + pair // FEATURES] * FEATURES + pair % FEATURES, minlength=4 * FEATURES)
            total[4 * FEATURES : 4 * FEATURES + 4] += np.bincount(kind[a:b], minlength=4)

    total = gathered(rows, add, 4 * FEATURES + 4)
    words, rows_of = total[: 4 * FEATURES].reshape(2, -1), total[4 * FEATURES :].reshape(2, -1)
    return np.concatenate([words, rows_of], axis=1)


def word_weights(counts: np.ndarray) -> np.ndarray:
    """Evidence of each feature: the log odds of toxic documents having it, less its uncertainty, 0 at least."""
    total = counts.astype(np.float64)
    clean, toxic = total[:FEATURES], total[FEATURES : 2 * FEATURES]
    n0, n1 = total[2 * FEATURES :]
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    return np.maximum(odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0).astype(np.float32)


def evidence(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, restore: Restorer) -> np.ndarray:
    """Of each text the three strongest words, the log of all evidence, and the log of its words."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.float64)
    for a, b in slices(offsets, 1 << 19):
        row, code = all_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], restore)
        if not len(row):
            continue
        value = np.where(code >= 0, weights[code], 0).max(axis=1).astype(np.float64)
        out[a:b, 4] = np.log1p(np.bincount(row, minlength=b - a))
        some = np.flatnonzero(value > 0.5)
        row, value = row[some], value[some]
        out[a:b, 3] = np.log1p(np.bincount(row, weights=value, minlength=b - a))
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for k in range(3):
            out[a + row[place == k], k] = value[place == k]
    return out


@dataclass
class Toxicity:
    model: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> np.ndarray:
        x = _design(evidence(data, offsets, self.weights, restore))
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -40, 40)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, np.maximum(x[:, 0] - 3, 0), np.maximum(x[:, 1] - 2, 0), x[:, 3] - x[:, 4]])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge, not on the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, evidence_sample: int = 200_000) -> Toxicity:
    """The character model from all documents, and word evidence from about ``evidence_sample`` labelled rows at most.
    The score's coefficients are fitted on about ``sample`` rows at most of one half, by evidence from the other half alone."""
    model = language_model(docs.select(whole_text().alias("text")))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))
    counts = word_counts(labelled(docs, labels, "toxic", evidence_sample).select("text", "y", half.cast("int").alias("half")), model)
    weights = word_weights(counts[0])
    restore = Restorer(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = evidence(*utf8(batch.column(0)), weights, restore)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    found = labelled(docs, labels.where(half == 1), "toxic", sample).select("text", "y").mapInArrow(tidy(features), "y int, x array<double>").collect()
    found = sorted((r.y, r.x) for r in found)
    x = np.array([r[1] for r in found], np.float64).reshape(len(found), 5)
    return Toxicity(model, word_weights(counts.sum(axis=0)), fit_logistic(_design(x), np.array([r[0] for r in found], np.float64)))


def score_toxicity(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """doc_id and score of every document; null text counts as empty."""
    restore = Restorer(fitted.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = fitted.score(*utf8(batch.column(1)), restore)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(run), "doc_id bigint, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learnt only from ids outside the held-out fold. Null and repeated
    ids are scored as any row; without usable labels every score is a half; an
    empty table gives an empty result; further columns are ignored.
    """
    fitted = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    return score_toxicity(docs, fitted).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
