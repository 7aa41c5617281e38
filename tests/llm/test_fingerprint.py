import hashlib
import random

import numpy as np
import pytest

from vitrine.llm import fingerprint as fp
from vitrine.llm.textbytes import joined


def sketch(text, k=fp.K):
    return fp.sketch_all(*joined([text.encode()]), k)[0]


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    return sorted(out, key=str)


WORDS = [f"w{i}é" for i in range(300)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a b c d")],
        [(1, None), (None, "x y"), (None, "zz zz zz"), (5, "abc def ghi"), (5, "abc"), (3, "")],
        [(None, "x y"), (None, "zz zz zz")],
        [(i * 7 % 101, " ".join(random.Random(i).choices(WORDS, k=i % 40))) for i in range(101)],
        [(1, "same text"), (1, "same text"), (2, "😀 a" * 2000)],
    ],
)
def test_edited(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, span string, ahead int")
    out = fp.edited_fingerprints(docs).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=str) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_estimates():
    rng = random.Random(2)
    for share in (0.0, 0.3, 0.7, 1.0):
        a = rng.choices(WORDS, k=1500)
        b = a[: int(1500 * share)] + rng.choices(WORDS, k=1500 - int(1500 * share))
        a, b = " ".join(a), " ".join(b)
        sa, sb = shingles(a), shingles(b)
        assert fp.resemblance(sketch(a), sketch(b)) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.13)
        assert fp.containment(sketch(a), sketch(b)) == pytest.approx(len(sa & sb) / len(sa), abs=0.2)
        assert fp.distinct(sketch(a)) == pytest.approx(len(sa), rel=0.35)


def test_merge_and_small_texts():
    a, b = " ".join(WORDS[:100]), " ".join(WORDS[50:250])
    assert (fp.merge(sketch(a), sketch(b)) == np.unique(np.concatenate([sketch(a, 10**6), sketch(b, 10**6)]))[: fp.K]).all()
    assert len(sketch("")) == 0 and len(sketch("a b")) == 1 and fp.resemblance(sketch(""), sketch(" ")) == 1
    assert (fp.decode(fp.encode(sketch(a))) == sketch(a)).all()
    assert fp.distinct(sketch("a b c d e f")) == 2
    same = " ".join(["x"] * 5000)
    assert len(sketch(same)) == 1


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    assert out[1] == out[2] != out[3] == ""
