import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitrine.llm import perfect, phrases
from vitrine.llm.phrases import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, level int"


def expected(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, r, n[lang], -score) for i, (score, a, p, x, r) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def check(spark, rows, least, most=2000, parts=4):
    found = collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts), least, most).collect()
    assert sorted(map(tuple, found)) == expected(rows, least, most)
    return found


def corpus(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "Été", "New", "YORK", "a.b", "x,", "(y"]
    phrase = ["new york city hall", "new York  city", "À la\tcarte", "the the the the the the"]
    out = []
    for i in range(n):
        text = [r.choice(phrase) if r.random() < 0.2 else r.choices(words, [1 / (j + 1) for j in range(len(words))])[0] for _ in range(r.randrange(50))]
        out.append((i, "".join(t + r.choice([" ", " ", "  ", ". ", "\n", "\x0b", "\t"]) for t in text), r.choice(["en", "en", "de", None, "und"]), None, 1))
    return out


@pytest.mark.parametrize(("least", "most"), [(30, 2000), (4, 2000), (4, 7), (1, 50)])
def test_equals_brute_force(spark, least, most):
    assert check(spark, corpus(300), least, most)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", "x", 2), *[(2, "a b a b", "", None, None)] * 40, (3, "z " * 50_000, "one", None, None), (4, "q" * 200_000 + " q", "one", None, None), (5, "...;;;\n\n", "none", None, None)]
    check(spark, rows, 30)
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_flushes_and_ranges_change_nothing(spark):
    rows = corpus(200, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check(spark, rows, 5, parts=9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_counts_by_slot_and_home(monkeypatch):
    """A phrase across slices of a block, and words at their ends."""
    import pyarrow as pa

    monkeypatch.setattr("vitrine.llm.textbytes.SLICE_BYTES", 8)
    block = pa.table({"lang": ["en", "en", "de"], "text": ["A b. c\td", "", "a b"]}).combine_chunks()
    words = phrases.parse(block)
    assert [bytes(words.data[i:j]) for i, j in zip(words.start, words.end, strict=True)] == [b"a", b"b", b"c", b"d", b"a", b"b"]
    assert words.follows.tolist() == [True, False, True, False, True, False]
    assert words.key[0] != words.key[4] and words.hash[0] == words.hash[4]


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, n, np.uint64))
    arrays = perfect.build(keys)
    assert sorted(perfect.slots(arrays, keys).tolist()) == list(range(len(keys)))
    strangers = np.setdiff1d(r.integers(0, 2**64, n, np.uint64), keys)
    assert (perfect.slots(arrays, strangers) == -1).all()
    assert len(arrays["bits"]) * 64 <= 4 * len(keys) + 64 * 20
