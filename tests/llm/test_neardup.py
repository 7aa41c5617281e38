import random

import numpy as np
import pytest

from vitrine.llm import neardup
from vitrine.llm.neardup import ENTRIES, WIDTH, alike, components, edit_distances, keep_one, near_duplicates, normal_words, occurrence_labelled, order_minhash
from vitrine.llm.textbytes import shingles


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_edit_distances():
    rng = random.Random(0)
    pairs, bounds, true = [], [], []
    for _ in range(2500):
        a = rng.choices(range(4), k=rng.randint(0, 60))
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choices(range(4), k=rng.randint(0, 2))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        bounds.append(rng.randint(0, 40))
        true.append(min(levenshtein(a, b), bounds[-1] + 1))
    assert edit_distances(pairs, np.array(bounds)).tolist() == true
    assert edit_distances([], np.array([])).tolist() == []


def test_edit_distances_of_long_texts():
    """Texts beyond 16-bit counts, and bands wider than the first."""
    a = np.random.default_rng(3).integers(0, 1 << 32, 9000, dtype=np.uint32)
    b = np.delete(np.insert(a, 100, a[:40]), slice(5000, 5100))
    c = a.copy()
    c[::10] = 0
    assert edit_distances([(a, b), (a, c), (c, b)], np.array([1800, 1800, 200])).tolist() == [140, 900, 201]


def test_sketch_keeps_order():
    kmers = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    same = (order_minhash(kmers, kmers) == order_minhash(kmers[::-1].copy(), kmers[::-1].copy())).mean()
    assert same == 0 and len(order_minhash(kmers[:1], kmers[:1])) == ENTRIES and len(order_minhash(kmers[:0], kmers[:0])) == 0


def planted(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, truth = [], {}

    def add(tokens, group):
        truth[len(rows)] = group
        rows.append((len(rows), " ".join(tokens), "s"))

    def edited(tokens, n):
        out = list(tokens)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    passage = rng.choices(words, k=60)
    for g in range(12):
        base = rng.choices(words, k=rng.randint(80, 300))
        for _ in range(rng.randint(2, 5)):
            add(edited(base, len(base) // 30), g)
    hot = rng.choices(words, k=150)
    for _ in range(60):
        add(edited(hot, 4), "hot")
    for _ in range(30):
        add(hot, "hot")
    for i in range(60):  # one passage in otherwise unlike texts
        add(rng.choices(words, k=70) + passage + rng.choices(words, k=30), ("passage", i))
    for i in range(60):
        add(rng.choices(words, k=rng.randint(5, 200)), ("own", i))
    return rows, truth


def test_planted(spark):
    rows, truth = planted()
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert len(out) == len(rows)
    members = {}
    for d, g in truth.items():
        members.setdefault(g, []).append(d)
    for r in out:
        group = members[truth[r.doc_id]]
        assert (r.class_id, r.class_size) == (min(group), len(group))
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(m) for m in members.values())


def test_edges(spark):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, "a b"), (None, "A, b!"), (4, "!!"), (5, twelve), (5, twelve[:-6] + "thirteen"), (6, "x " * 30_000), (6, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted([tuple(r) for r in near_duplicates(docs).collect()], key=str)
    assert out == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 2), (None, 3, 2), (4, 4, 1), (5, 5, 2), (5, 5, 2), (6, 6, 2), (6, 6, 2)], key=str)
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == ["1", "3", "4", "5", "6"]
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == 1 and out[100] == out[101] != out[0] and len(out) == 43


@pytest.mark.parametrize(("changes", "expected"), [(0, True), (20, True), (21, False)])
def test_similarity_bound(changes, expected):
    a = np.arange(100, dtype=np.uint32)
    b = a.copy()
    b[:changes] += 1000
    assert alike([(a, b)], 0.8).tolist() == [expected]


@pytest.mark.parametrize("block", [2000, 40])
def test_components_equal_brute_force(spark, monkeypatch, block):
    """Variants of one base with about a tenth of its words edited: many pairs are near the bound, so every member
    of a bucket counts. With the small block buckets are parted, and parts meet in several blocks."""
    monkeypatch.setattr(neardup._rest_of_buckets, "__defaults__", (block,))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base, texts = rng.choices(words, k=100), []
    for _ in range(300):
        one = list(base)
        for at in rng.sample(range(100), rng.randint(12, 14)):
            one[at] = rng.choice(words)
        texts.append(one)
    passage = rng.choices(words, k=45)
    texts += [rng.choices(words, k=30) + passage + rng.choices(words[:20], k=15) for _ in range(500)]  # many share a bucket, few are alike
    numbers = [np.array([int(w[1:]) for w in t], np.uint32) for t in texts]
    sketches = []
    for t in texts:
        data = " ".join(t).encode()
        hashed, row = normal_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        kmers, _ = shingles(hashed, row, 1, WIDTH)
        sketches.append(order_minhash(kmers, occurrence_labelled(kmers, np.zeros(len(kmers), np.int64))))
    sketches = np.stack(sketches)
    pairs = [(i, int(j)) for i in range(len(texts)) for j in np.flatnonzero((sketches[:i] == sketches[i]).any(axis=1))]
    good = alike([(numbers[i], numbers[j]) for i, j in pairs], 0.8)
    name = np.arange(len(texts))
    for (i, j), linked in zip(pairs, good, strict=True):
        if linked and name[i] != name[j]:
            old, new = sorted((name[i], name[j]))[::-1]
            name[name == old] = new
    assert 2 < len(set(name[:300].tolist())) < 300
    out = near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == dict(enumerate(name.tolist()))
