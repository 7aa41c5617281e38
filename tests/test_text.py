import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.functions.chunk import chunk_rows, chunks
from vitrine.functions.stem import stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_tokens(spark):
    assert one(spark, "Foo_bar iechä Navy-Blue 2011.0 ñañ x2", T.tokens) == ["navy", "blue", "2011", "0", "x2"]
    assert one(spark, None, T.tokens) == [] and one(spark, "", T.tokens) == []
    assert one(spark, "The men and Women", lambda c: T.without(T.tokens(c), ["the", "men"])) == ["and", "women"]


def test_chunk_carries_last_unit():
    assert [len(c) for c in chunks("\n".join(["a" * 100] * 3))] == [100, 201, 201]
    assert [len(c) for c in chunks("b" * 360)] == [160, 321, 201]
    assert chunks("  \n ") == [] and chunks(None) == [] and chunks("short text") == ["short text"]


def test_chunk_keeps_every_word():
    rng = random.Random(1)
    for _ in range(50):
        words = [str(i) + "x" * rng.randrange(12) for i in range(rng.randrange(1, 120))]
        text = "".join(w + rng.choice([" ", "\n", "\n\n"]) for w in words)
        found = chunks(text)
        assert {w for c in found for w in c.split()} == set(words)
        assert all(len(c) <= 2 * 160 + 1 for c in found)


def test_chunk_rows(spark):
    rows = chunk_rows(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(2, 0, "a b")]


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consigned", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("generically", "generic"), ("happy", "happi"),
        ("running", "run"), ("flies", "fli"), ("dies", "die"), ("hopping", "hop"), ("hoped", "hope"), ("agreed", "agre"), ("relational", "relat"),
        ("conditional", "condit"), ("dying", "die"), ("skies", "sky"), ("only", "onli"), ("yes", "yes"), ("by", "by"), ("innings", "inning"),
        ("kneeling", "kneel"), ("knightly", "knight"), ("consolation", "consol"), ("adjustment", "adjust"), ("cry", "cri"), ("ties", "tie"), ("gas", "gas"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_records(spark):
    r = one(spark, "a|b", T.unpack_record)
    assert (r.gender, r.master_category, r.sub_category, r.product_name) == ("a", "b", "", "")
    assert one(spark, "|".join("abcdefghij"), T.unpack_record).product_name == "i"
    assert one(spark, None, T.unpack_record).gender == "" and one(spark, "x|y|z", T.sub_category) == "z"
    assert one(spark, "x", T.sub_category) == ""
    packed = spark.createDataFrame([("a", None, 3)], "x string, y string, z int").select(T.pack_record([F.col(c) for c in "xyz"]).alias("r")).first().r
    assert packed == "a|nan|3"


def test_cleaning(spark):
    rows = spark.createDataFrame([(" NaN ",), (None,), ("",), ("undefined",), ("http://a",)], "v string")
    assert [r.v for r in rows.where(T.is_defined(F.col("v"))).collect()] == ["http://a"]
    assert one(spark, "x/y/123.jpg", T.file_id) == 123 and one(spark, "abc", T.file_id) is None
    assert one(spark, "1,2,3,4,5,6,7,8,9,a,b", T.repair_line)[-1] == "a,b"
