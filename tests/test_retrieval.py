"""Fusion from the upper ends of lists, and codebooks of batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import bucketed, index, ranking, threshold
from vitrine.operators.knn import knn_exact
from vitrine.sources import tables


def entries(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("weights", [(60, 40), (1, 0), (0, 1), (0.2, 0.9)])
def test_fusion_from_the_top_equals_full_lists(spark, weights):
    """Documents without a vector or a word, queries without one or the other, ties, negative scores, and lists that end."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choice(words, int(r.integers(0, 9))))) for i in range(70)] + [(100 + i, "w1 w2") for i in range(9)]
    vectors = [(i, r.normal(size=4).round(1).tolist() if i % 9 else [0.0] * 4) for i in range(20, 95)] + [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    asked = tables.query_frame(spark, ["w1 w2 w2", "w3", "", "unseen", "w5 w6"])
    images = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [-1.0, 0.5, 0.0, 0.0]), (2, [0.3, 0.3, 0.3, 0.3]), (7, [1.0, 1.0, 1.0, 1.0])], "query_id long, vector array<double>")
    queries = asked.select("query_id").union(images.select("query_id"))
    built = index.build_index(index.term_frequencies(docs), len(texts))
    tf = index.term_frequencies(asked, key="query_id")
    text, near = index.score(built, tf).withColumn("score", F.round("score", 6)), knn_exact(known, images, None).drop("rank")
    want = entries(ranking.top_k(ranking.fuse(text, near, *weights), 5, digits=6))
    for first in (1, 8, 500):
        found = threshold.fuse_top(queries, threshold.text_side(built, tf), threshold.vector_side(known, images), *weights, 5, first=first)
        assert entries(found) == want
        if weights == (60, 40) and first == 8:
            assert min(x["read"] for x in found.collect()) < len(texts) // 2
    with pytest.raises(ValueError):
        threshold.fuse_top(queries, threshold.text_side(built, tf), threshold.vector_side(known, images), -1, 1, 5)


def test_batches_in_order_of_arrival(spark, tmp_path):
    """Against a plain loop over the same batches from the same first centres."""
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(size=(400, 5)) + 4 * m for m in (0, 1, 2)])[r.permutation(1200)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (2000, None)], "doc_id long, embedding array<double>").repartition(7)
    model = index.minibatch_codebook(df, str(tmp_path), k=8, batch=250, seed=1)
    first = x[:250][np.lexsort(x[:250].T[::-1])]
    plain = index.MiniBatches.start(first, 8, 1)
    centres, counts = plain.centres.copy(), np.zeros(8)
    for a in range(0, 1200, 250):
        part = x[a : a + 250]
        place = np.round((centres**2).sum(axis=1) - 2 * part @ centres.T, 9).argmin(axis=1)
        for j in range(8):
            own = part[place == j]
            if len(own):
                counts[j] += len(own)
                centres[j] += (own.sum(axis=0) - len(own) * centres[j]) / counts[j]
    assert model.counts.tolist() == counts.tolist() and model.counts.sum() == 1200
    assert np.allclose(model.centres, centres, atol=1e-9)


def test_batches_of_few_vectors(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    model = index.minibatch_codebook(few, str(tmp_path / "a"), k=5, batch=2)
    assert len(model.centres) == 1 and model.counts.tolist() == [3]  # the first batch has one vector, twice
    assert index.minibatch_codebook(few, str(tmp_path / "b"), k=5, batch=3).counts.sum() == 3
    assert len(index.minibatch_codebook(few.limit(0), str(tmp_path / "c"), k=5).centres) == 0


def exchanges_above(plan, name):
    """Exchanges between the scan of a table and the first join above it, in a formatted plan's tree."""
    lines = plan.split("== Physical Plan ==")[1].split("\n\n")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if name in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*")), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*"))
        if own < depth:
            depth = own
            if "Join" in line:
                return found
            found += [line] if "Exchange" in line else []
    raise AssertionError("no join above")


def test_buckets_stay_where_they_are(spark, tmp_path, capsys):
    """With neither side broadcast: an exchange above the queries, none above postings and records."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} x") for i in range(200)], "doc_id long, text string")
    built = index.build_index(index.term_frequencies(docs), 200)
    tf = index.term_frequencies(tables.query_frame(spark, ["w1 w2", "w3 w3"]), key="query_id")
    want = entries(ranking.top_k(index.score(built, tf), 9, digits=6))
    kept = bucketed.write_index_bucketed(built, "vitrine_test", str(tmp_path / "text"), 4)
    records = bucketed.write_bucketed(docs, "vitrine_test_records", str(tmp_path / "records"), "doc_id", 4)
    other = bucketed.attach(spark, "vitrine_test_again", str(tmp_path / "records"), "doc_id BIGINT, text STRING", "doc_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = index.score(kept, tf)
        scored.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and exchanges_above(plan, "vitrine_test_postings") == []
        found = ranking.top_k(scored, 9, digits=6)
        assert entries(found) == want
        for table, name in ((records, "vitrine_test_records"), (other, "vitrine_test_again")):
            joined = found.join(table, "doc_id")
            joined.explain()
            assert exchanges_above(capsys.readouterr().out, name) == []
            assert joined.count() == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        for name in ("vitrine_test_postings", "vitrine_test_records", "vitrine_test_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
