import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vitrine.llm import ngrams
from vitrine.llm.arrays import pack, unpack
from vitrine.llm.ngrams import fit_ngrams, language_model_scores, score_texts

SCHEMA = "doc_id long, text string, n_tokens string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Model:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order, grams, self.seen = order, Counter(), Counter()
        for text in texts:
            words = ["<s>"] * (order - 1) + tokens(text)
            self.seen.update(words[order - 1 :])
            grams.update(tuple(words[i : i + order]) for i in range(len(words) - order + 1))
        self.counts = {order: grams}
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.d, self.after = {}, {}
        for m, counts in self.counts.items():
            t = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
            d = ngrams.PLAIN
            if min(t) > 0:
                y = t[0] / (t[0] + 2 * t[1])
                own = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3))
                d = own if all(0 <= x <= k + 1 for k, x in enumerate(own)) else d
            self.d[m], after = d, defaultdict(list)
            for g, c in counts.items():
                after[g[:-1]].append(c)
            self.after[m] = after

    def p(self, context, word):
        m = len(context) + 1
        lower = self.p(context[1:], word) if m > 1 else 1 / (len(self.counts[1]) + 1)
        after = self.after[m].get(context)
        if not after:
            return lower
        c, d = self.counts[m][(*context, word)], self.d[m]
        cut = c - d[min(c, 3) - 1] if c else 0
        return (max(cut, 0) + sum(d[min(x, 3) - 1] for x in after) * lower) / sum(after)

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + tokens(text)
        n, v = sum(self.seen.values()), len(self.seen)
        own = words[self.order - 1 :]
        base = math.fsum(math.log10((self.seen[w] + 1) / (n + v + 1)) for w in own)
        score = math.fsum(math.log10(self.p(tuple(words[i : i + self.order - 1]), w)) for i, w in enumerate(own))
        return len(own), sum(w in self.seen for w in own), n, round(base, 9), round(score, 9)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "Été", "THE", "the"]
    return [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randrange(0, 60))) + r.choice(["", "\n", "\x0b x"]) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_dictionaries(spark, order):
    texts = corpus(120)
    model = fit_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    own = Model(texts, order)
    asked = [*texts[:20], *corpus(20, 2), "unseen words only", "", None, "w0 w0 w0 w0 unseen w1"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    for r in score_texts(rows, model, "i").collect():
        n, known, train, base, score = own.score(asked[r.i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)
        assert r.perplexity == pytest.approx(10 ** (-score / n))


def test_adds_up_to_one():
    own = Model(corpus(50), 3)
    for context in [("<s>", "<s>"), ("w0", "w1"), ("unseen", "w0"), ("w3", "</s>")]:
        assert sum(own.p(context, w) for (w,) in own.counts[1]) + own.p(context, "unseen") == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(None, "a b a", "x"), (None, None, None), *[(7, "a  b\ta", "x")] * 300, *[(i, "", None) for i in range(20)], (99, "long " * 30_000, "x")]
    held = [zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows]
    own = Model([r[1] for r, h in zip(rows, held, strict=True) if not h], 2)
    found = language_model_scores(spark.createDataFrame(rows, SCHEMA)).drop("perplexity").collect()
    want = [(r[0], h, *own.score(r[1])) for r, h in zip(rows, held, strict=True)]
    key = lambda r: str(r[:5])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language_model_scores(empty).collect() == []
    row = score_texts(spark.createDataFrame([("a b",)], "text string"), fit_ngrams(empty)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        fit_ngrams(empty, 1)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    """Pieces and ranges are cut elsewhere, large counts go to the list of their own."""
    texts = corpus(200) * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    whole = fit_ngrams(df)
    import numpy as np

    words, bounds = ngrams.tokens(*_joined(texts))
    above = ngrams.contexts(words, bounds, 2)
    monkeypatch.setattr(ngrams, "PIECE", 64)
    total = 0
    for row in ngrams._gram_rows(above, words, 3):
        total += int(unpack(row[3])["counts"].sum())
    assert total == len(words) == whole.tokens
    counts = np.array([1, 254, 255, 256, 70_000])
    assert ngrams._counts(unpack(pack(**ngrams._small(counts))), np.arange(5)).tolist() == counts.tolist()


def _joined(texts):
    from vitrine.llm.textbytes import joined

    return joined([t.encode() for t in texts])
