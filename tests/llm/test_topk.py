import math
import random
import re
from collections import Counter

from vitrine.llm.topk import search


def brute(docs, queries, k):
    find = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (t or "").lower())
    bags = [(d, Counter(find(t))) for d, t in docs]
    n, average = len(bags), max(1.0, sum(sum(b.values()) for _, b in bags) / max(1, len(bags)))
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, t in queries:
        scored = []
        for d, b in bags:
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average)) for w, c in Counter(find(t)).items() if b[w])
            if any(b[w] for w in find(t)):
                scored.append((-round(s, 9), -1 if d is None else d))
        out += [(q, i + 1, None if d < 0 else d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(600)]
    docs += [(700, None), (None, "w1 w2 W3"), (701, "w1 w2"), (702, "w1 w2"), (702, "w1 w2"), (703, "É é w1")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)] + [(90, None), (91, "zzz"), (92, "é"), (93, "w1 w1 w2")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, rank int")
    q = spark.createDataFrame(queries, "query_id long, text string")
    for k, shard in ((10, 5000), (3, 40)):
        assert sorted([tuple(r) for r in search(d, q, k, shard).collect()], key=str) == brute(docs, queries, k)
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0


def test_blocks_of_long_queries(spark, monkeypatch):
    """Queries of any number and length: the driver takes them in blocks, long ones are scored whole."""
    from vitrine.llm import topk

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(200)] + [(None, "w1 w2 w3"), (200, "w1 w2 w3"), (201, "w1 w2 w3")]
    queries = [(d, t) for d, t in docs if d is not None and d % 4 == 0]
    monkeypatch.setattr(topk, "QUERY_BYTES", 8000)
    sizes = []
    hits = topk._hits
    monkeypatch.setattr(topk, "_hits", lambda texts, asked, *rest: sizes.append(len(asked)) or hits(texts, asked, *rest))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert sorted([tuple(r) for r in search(d, q, 10, 60).collect()], key=str) == brute(docs, queries, 10)
    assert len(sizes) > 2 and sum(sizes) == len(queries)


def test_every_twentieth_document_is_asked(spark):
    import os

    import duckdb
    import pytest

    from vitrine.llm.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op10_topk_documents"](spark, data).collect())
    want = sorted(con.execute(ORACLES["op10_topk_documents"]).fetchall())
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want] and len({q for q, *_ in got}) >= 9
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True)) and sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) == len(want)
