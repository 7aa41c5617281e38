import random
import zlib

import numpy as np
import pytest

from vitrine.llm.packing import first_fit_decreasing, pack, vocabulary_path
from vitrine.llm.textbytes import joined
from vitrine.llm.tokens import WordEncoder

pytest.importorskip("public_tokenizers")

ODD = [
    "", "  ", "Don't stop 's I'll", "<|endoftext|>a <|startoftext|>", "é É ß ÀÖ×÷ é ÿ Ÿ İ", "a\x1cy \x85z\x7f\x00", "１２ ³ ½ 漢字 かな", "mail.x@y.com +1 (23) a1b2-c3",
    "aaaaaaaa" * 40, "#%&$$$ ...!!! ((( )))", "Å K", "ǅ ﬁ 👍🏽", "x" * 100_000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("abAB'1. é<|É漢\ńthe in", k=40)) for _ in range(400)]
    encoder = WordEncoder(vocabulary_path())
    for _ in range(2):  # the second time from the cache
        ids, at = encoder.encode(*joined([t.encode() for t in texts]))
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def naive_first_fit(sizes, capacity):
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(capacity)
        out[i] = (b, capacity - free[b])
        free[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


def test_tree_is_first_fit():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 90))]
        bins, offsets = first_fit_decreasing(np.array(sizes), 64)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == naive_first_fit(sizes, 64)


def test_pack(spark, library):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "cat", "zxq", "10"], k=rng.randrange(400)))) for i in range(200)]
    rows += [(None, None), (7, ""), (7, ""), (500, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    out = pack(docs, group_docs=50).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, text in rows:
        if d == 7:
            continue
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda r: r.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert len(by_doc[7]) == 3
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert pack(docs.limit(0)).count() == 0
