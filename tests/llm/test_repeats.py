import hashlib
import random
import re
from collections import Counter

import pytest

from vitrine.llm.repeats import remove_repeats


def spans_of(b):
    return [m.span() for m in re.finditer(rb"[^ \t\n\x0b\f\r]+", b)]


def brute(rows, width, words):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in texts for i in range(len(b) - width + 1))
    passages = Counter(p for _, b in texts for p in {b[x[0] : y[1]] for x, y in zip(spans_of(b), spans_of(b)[words - 1 :], strict=False)})
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        held = set()
        for i, first in enumerate(spans_of(b)[: 1 - words or None]):
            if passages[b[first[0] : spans_of(b)[i + words - 1][1]]] > 1:
                held |= set(range(i, i + words))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), len(held)))
    return sorted(out, key=str)


def pieces(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(n // 3)]
    return [(i, rng.choice(texts)[: rng.randrange(1, 300)] + rng.choice(texts)[rng.randrange(100) :][: rng.randrange(900)]) for i in range(n)]


@pytest.mark.parametrize(
    ("rows", "options"),
    [
        ([], {}),
        ([(1, None), (2, ""), (None, "a" * 399)], {}),
        ([(1, "a" * 1000), (2, "b" * 400), (3, "b" * 400), (3, "ab" * 399)], {}),
        ([(1, "x" * 399 + "y"), (2, "z" + "x" * 399 + "y")], {}),
        ([(i, f"{i} " + " ".join(f"w{k}" for k in range(50)) + f" {i}") for i in range(3)] + [(9, "of the " * 60 + "end"), (10, "at the " * 60), (11, "at the " * 27)], {}),
        (pieces(3, 150), {"width": 40, "trigger": 4, "mean": 4, "block_bytes": 5000, "words": 8}),
        (pieces(4, 60), {"width": 40, "trigger": 16, "mean": 64, "block_bytes": 3000, "words": 5}),
    ],
)
def test_equals_brute_force(spark, rows, options):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block int, digest string")
    out = sorted([tuple(r) for r in remove_repeats(docs, **options).collect()], key=str)
    assert out == brute(rows, options.get("width", 400), options.get("words", 50))
