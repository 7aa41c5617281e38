import random
import zlib

import numpy as np
import pytest

from vitrine.llm.quality import classify_quality, fit_network, index_vectors, tokens
from vitrine.llm.textbytes import joined
from vitrine.llm.toxicity import Restorer, classify_toxicity, disguised, fit_logistic, language_model

WORDS = ["river", "garden", "window", "letter", "market", "summer", "silver", "paper", "stone", "music", "bridge", "worthy", "stoop", "loss"]
BAD = ["idiot", "stupid", "scum", "worthless"]


def corpus(n, spoil, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(WORDS, k=rng.randint(15, 60))
        rows.append((i, spoil(words, rng) if bad else " ".join(words), "s"))
        if rng.random() < 0.8:
            labels.append((i, int(not bad), int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def test_quality(spark):
    rows, labels = corpus(500, lambda w, r: " ".join(x.upper() + "!!" for x in w) if r.random() < 0.5 else " | ".join(w), 1)
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "river", "s"), (3, "copy of an id", "s")]
    docs, known = frames(spark, rows, [*labels, (9001, None, None)])
    out = classify_quality(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 5, 0)) for r in out)
    truth = {i: q for i, q, _ in labels if i != 3}
    test = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(test) > 40 and np.mean([a == b for a, b in test]) > 0.95
    rounded = lambda rows: {(r.doc_id, round(r.score, 6)) for r in rows}
    assert rounded(classify_quality(docs.repartition(3), known).collect()) == rounded(out)
    assert {r.score for r in classify_quality(docs, known.limit(0)).collect()} == {0.5}
    assert classify_quality(docs.limit(0), known).count() == 0


def test_network_and_tokens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no linear model can do this
    assert ((fit_network(x, y).score(x) > 0.5) == y).mean() > 0.9
    assert (np.abs(index_vectors(50, 32, 1)).sum(axis=1) == 4).all()
    word, shape, row = tokens(*joined([b"the THE", b"the!!"]))
    assert word[0] == word[1] == word[2] and shape[0] != shape[1] and row.tolist() == [0, 0, 1, 1]


def insult(words, rng):
    word = rng.choice(BAD)
    if rng.random() < 0.3:
        word = word.replace("i", "1").replace("o", "0").replace("s", "$", 1)
    elif rng.random() < 0.2:
        word = " ".join(word)
    words[rng.randrange(len(words))] = word
    return " ".join(words)


def test_toxicity(spark):
    rows, labels = corpus(700, insult, 2)
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "river", "s"), (9003, "y" * 50_000, "s")]
    docs, known = frames(spark, rows, labels)
    out = classify_toxicity(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 3, 1)) for r in out)
    truth = {i: t for i, _, t in labels}
    test = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(test) > 80 and np.mean([a == b for a, b in test]) > 0.95
    assert {r.score for r in classify_toxicity(docs, known.limit(0)).collect()} == {0.5}
    assert classify_toxicity(docs.limit(0), known).count() == 0


@pytest.fixture(scope="module")
def restore(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(WORDS + BAD, k=60)),) for _ in range(80)]
    return Restorer(language_model(spark.createDataFrame(rows, "text string")))


@pytest.mark.parametrize(("text", "word"), [("1d10t", "idiot"), ("s.t.u.p.1.d", "stupid"), ("$cum", "scum"), ("iiidiooot", "idiot"), ("w0rthl3ss", "worthless"), ("s c u m", "scum"), ("stup!d,", "stupid")])
def test_restored(restore, text, word):
    (found,) = disguised(*joined([text.encode()]))
    assert restore(found[1]) == [word]


def test_plain_words_stay():
    assert disguised(*joined(["The river, (silver) worthless music!! a**".encode(), b"", b"x | y"])) == []
    x = np.column_stack([np.ones(200), np.arange(200)])
    assert fit_logistic(x, (np.arange(200) > 100).astype(float))[1] > 0
