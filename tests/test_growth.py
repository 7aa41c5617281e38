"""What keeps the memory, the shuffles and the jobs of queries from growing faster than their tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.operators import bucketed, fulltext, index, knn, ranking, threshold
from vitrine.plans import engine
from vitrine.sources import sinks, tables
from vitrine.streaming import upkeep


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def entries(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} x") for i in range(200)], "doc_id long, text string")
    asked = index.term_frequencies(tables.query_frame(spark, ["w1 w2", "w3 w3 w0", "x", "unseen"]), key="query_id")
    return index.term_frequencies(docs), asked


def test_scores_are_summed_up_where_documents_are(spark, corpus, tmp_path):
    """No row for each term that a query and a document share is dealt out."""
    tf, asked = corpus
    built = index.build_index(tf, 200)
    scored = index.score(built, asked)
    want = entries(ranking.top_k(scored, 9, digits=6))
    assert "hashpartitioning(query_id" not in plan(scored)
    kept = bucketed.write_index_bucketed(built, "vitrine_growth", str(tmp_path / "b"), 4)
    try:
        scored = index.score(kept, asked)
        assert "hashpartitioning(query_id" not in plan(scored) and entries(ranking.top_k(scored, 9, digits=6)) == want
    finally:
        spark.sql("DROP TABLE IF EXISTS vitrine_growth_postings")
    linear = index.score_linear(tf, asked, 200)
    assert "hashpartitioning(query_id" not in plan(linear) and entries(ranking.top_k(linear, 9, digits=6)) == want
    written = index.write_index(tf, 200, str(tmp_path / "w"))
    for file in os.listdir(tmp_path / "w" / "postings"):  # a document is in one file
        if file.endswith(".parquet"):
            own = pd.read_parquet(tmp_path / "w" / "postings" / file)
            assert written.postings.where(F.col("doc_id").isin(sorted(set(own.doc_id)))).count() == len(own)
    assert entries(ranking.top_k(index.score(written, asked), 9, digits=6)) == want


def test_lists_are_made_once(spark, corpus, monkeypatch):
    """However many rounds a fusion takes."""
    tf, asked = corpus
    calls = []
    monkeypatch.setattr(threshold, "score", lambda *a: calls.append("text") or index.score(*a))
    monkeypatch.setattr(threshold, "knn_exact", lambda *a, **b: calls.append("image") or knn.knn_exact(*a, **b))
    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(200)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(4)], "query_id long, vector array<double>")
    found = threshold.fuse_top(queries.select("query_id"), threshold.text_side(index.build_index(tf, 200), asked), threshold.vector_side(vectors, queries), 60, 40, 5, first=5)
    assert max(x["read"] for x in found.collect()) > 10 and sorted(calls) == ["image", "text"]


def test_products_in_tiles(monkeypatch):
    """Equal to a full sort with ties, and never more similarities at once than a tile has."""
    r = np.random.default_rng(5)
    x = r.integers(-1, 2, size=(60, 3)).astype(float)
    q = r.normal(size=(40, 3)).round(1) + 0.05
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    monkeypatch.setattr(knn, "TILE", 120)
    frames = list(knn._best(np.arange(40), q, pd.DataFrame({"doc_id": np.arange(60)[::-1], "vector": list(x)}), 7, "doc_id", 6))
    assert len(frames) == 40 // (120 // (np.linalg.norm(x, axis=1) > 0).sum()) and max(map(len, frames)) <= 14
    some = np.linalg.norm(x, axis=1) > 0
    near = np.round(q @ (x[some] / np.linalg.norm(x[some], axis=1, keepdims=True)).T, 6)
    own = np.arange(60)[::-1][some]
    want = [own[np.lexsort((own, -row))[:7]].tolist() for row in near]
    assert pd.concat(frames).groupby("query_id").doc_id.apply(list).tolist() == want


def test_histograms_as_products(spark):
    """The ranked scores of the index, ties and documents that share nothing with the query included."""
    r = np.random.default_rng(2)
    rows = {(int(d), int(c)): int(n) for d, c, n in zip(r.integers(0, 80, 160), r.integers(0, 6, 160), r.integers(1, 3, 160), strict=True)}
    tf = spark.createDataFrame([(d, c, n) for (d, c), n in rows.items()], "doc_id long, codeword_id long, tf long")
    built, asked = index.build_index(tf, 80, "codeword_id"), tf.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    for k in (3, 500):
        assert entries(knn.nearest_histograms(built, asked, 6, k)) == entries(ranking.top_k(index.score(built, asked), k, digits=6))


def test_batches_are_folders(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(100)], "doc_id long, embedding array<double>").repartition(5)
    assert index.minibatch_codebook(rows, str(tmp_path), k=4, batch=30).counts.sum() == 100
    assert {f"batch={i}" for i in range(4)} <= set(os.listdir(tmp_path / "batches"))


def test_dense_without_a_look_up(spark):
    tf = spark.createDataFrame([(1, 0, 2), (1, 4, 1), (2, 2, 3)], "doc_id long, codeword_id long, tf long")
    found = index.dense(tf, 5)
    assert {r.doc_id: r.histogram for r in found.collect()} == {1: [2, 0, 0, 0, 1], 2: [0, 0, 3, 0, 0]}
    assert "map_from_entries" not in plan(found)
    with pytest.raises(Exception, match="twice"):
        index.dense(tf.union(tf.limit(1)), 5).collect()


def test_places_without_collecting(spark):
    """Rows of one id that come in several batches, stop words, null ids and empty texts."""
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (None, "a"), (1, "a the b"), (3, None), (1, "c"), (None, "a a")], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = fulltext.positions(docs, ["the"])
        assert "collect_list" not in plan(found)
        assert {(r.doc_id, r.term): r.positions for r in found.collect()} == {(1, "a"): [1, 2], (1, "b"): [1, 3, 3], (1, "c"): [1], (None, "a"): [1, 1, 2]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_of_what_is_added_up(spark, tmp_path, monkeypatch):
    """More rows are added up in more tasks."""
    store = upkeep.Store.create(spark, str(tmp_path))
    store.apply(spark.createDataFrame([(i, "", f"w{i} x", 0) for i in range(40)], "doc_id long, url string, text string, order long"), 0)
    monkeypatch.setattr(upkeep, "MOST_SUMMED", 8)
    found = store.frequencies()
    assert found.rdd.getNumPartitions() == 10 and found.count() == 80


def test_an_engine_in_memory_is_counted_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(engine, "write_table", lambda table, path: made.append(path.rsplit("/", 1)[1]) or sinks.write_table(table, path))
    docs = spark.createDataFrame([(1, "u", "red shirts"), (2, "v", "blue jeans")], "doc_id long, url string, text string")
    built = engine.Engine.build(spark, docs)
    assert built.search_text("shirt").first().doc_id == 1 and made == ["frequencies", "codebook"]
