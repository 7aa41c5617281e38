import random

import pytest

from vitrine.llm.mixing import mix_sources, mixture


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        left = {s: w[s] for s in names if s not in full}
        rest = budget - sum(full.values())
        over = {s: most * sizes[s] for s in left if rest * w[s] / sum(left.values()) > most * sizes[s]}
        if not over:
            return full | {s: rest * w[s] / sum(left.values()) for s in left}
        full |= over


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string")


def test_mix(spark):
    rng = random.Random(1)
    sources = ["a", "b", "é", None, "z"]
    rows = [(i, " ".join("w" * rng.randrange(9)), sources[min(4, int(rng.expovariate(1.2)))], None, "x") for i in range(700)]
    rows += [(None, None, "a", 1, None), (None, "", None, 1, None), (5, "a b c", "a", 1, ""), (5, "a b c", "a", 1, "")]
    out = mix_sources(frame(spark, rows), bucket_rows=16).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in own)
        assert 0 <= want[s] - sum(r.taken for r in own) < 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = mix_sources(frame(spark, rows).repartition(9), bucket_rows=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    out = mix_sources(frame(spark, [(1, None, None, 1, ""), (2, " ", "a", 1, "")])).collect()
    assert [(r.taken, r.target) for r in out] == [(0, 0.0)] * 2


def test_mixture_has_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(5 + i % 7)), "ab"[i % 2] if i % 5 else None, i, "k") for i in range(60)]
    docs = frame(spark, rows)
    plan, out = mix_sources(docs).collect(), mixture(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in plan)
    texts = {r[0]: r[1] for r in rows}
    assert mixture(docs).columns == docs.columns and all(texts[r.doc_id].startswith(r.text) for r in out)
    assert mixture(frame(spark, [])).count() == 0


def test_rows_of_one_id(spark, monkeypatch):
    """Many rows without an id, and of one id: each is cut where it stands, in order of size, also over several steps."""
    monkeypatch.setattr("vitrine.llm.mixing.COPIES", 50)
    rows = [(None, " ".join("w" * (i % 4)), "a", 1, "") for i in range(500)] + [(7, "x y z", "b", 1, "")] * 130
    out = mix_sources(frame(spark, rows), bucket_rows=16).collect()
    want = brute_targets({"a": 750, "b": 390})
    assert len(out) == len(rows)
    for source, sizes in (("a", sorted(len(r[1].split()) for r in rows if r[2] == "a")), ("b", [3] * 130)):
        whole, rest = divmod(int(want[source]), sum(sizes))
        taken, left = [], rest
        for n in sizes:
            taken.append(whole * n + min(n, left))
            left -= min(n, left)
        assert sorted((r.size, r.taken) for r in out if r.source == source) == sorted(zip(sizes, taken, strict=True))


def test_names_with_dots_and_backticks(spark):
    from vitrine.llm.pii import sanitise

    docs = frame(spark, [(1, "write to a.b@example.org now", "a", 1, "k"), (2, "plain words here", "b", 2, "l")])
    docs = docs.withColumnRenamed("size", "a`b").withColumnRenamed("key", "c.d")
    for made in (mixture(docs), sanitise(docs)):
        assert made.columns == docs.columns
        assert {r["a`b"] for r in made.collect()} <= {1, 2} and {r["c.d"] for r in made.collect()} <= {"k", "l"}
