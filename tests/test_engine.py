import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import descriptors, grey, nearest_codeword, patches
from vitrine.operators import evaluate, fulltext, graph, index, knn, ranking
from vitrine.operators.index import build_index, score, term_frequencies
from vitrine.plans.engine import Engine, enriched, formatted
from vitrine.sources import sinks, tables

RECORDS = [
    (1, "u1", "Men|Apparel|Topwear|Shirts|Navy Blue|Fall|2011.0|Casual|Turtle Check Men Navy Blue Shirt"),
    (2, "u2", "Men|Apparel|Bottomwear|Jeans|Blue|Summer|2012.0|Casual|Peter England Men Party Blue Jeans"),
    (3, "u3", "Women|Accessories|Watches|Watches|Silver|Winter|2016.0|Casual|Titan Women Silver Watch"),
    (4, "", "Men|Apparel|Topwear|Tshirts|Grey|Summer|2012.0|Casual|Puma Men Grey T-shirt"),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(RECORDS, "doc_id long, url string, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_idf_and_norm(spark):
    tf = spark.createDataFrame([(d, "all", 1) for d in range(4)] + [(0, "one", 2)], "doc_id long, term string, tf long")
    built = index.build_index(tf, 4)
    idf = {r.term: r.idf for r in built.idf.collect()}
    assert idf["all"] == 0 and idf["one"] == pytest.approx(np.log(4))
    assert {r.doc_id: r.norm for r in built.norms.collect()}[0] == pytest.approx(2 * np.log(4))


def test_index_equals_scan(spark, products):
    tf = index.term_frequencies(products.select("doc_id", "text"))
    asked = index.term_frequencies(tables.query_frame(spark, ["men blue shirt", "silver watch 2016", "zzz"]), key="query_id")
    a = {(r.query_id, r.doc_id): r.score for r in index.score(index.build_index(tf, 4), asked).collect()}
    b = {(r.query_id, r.doc_id): r.score for r in index.score_linear(tf, asked, 4).collect()}
    assert a.keys() >= b.keys() and all(a[k] == pytest.approx(b[k]) for k in b) and all(-1e-9 <= s <= 1 + 1e-9 for s in a.values())
    moved = index.score(index.build_index(tf.repartition(7), 4), asked)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in moved.collect()} == {k: round(s, 9) for k, s in a.items()}


def test_top_k_ties_and_pages(spark):
    scored = spark.createDataFrame([(0, 7, 0.5), (0, 3, 0.5), (0, 9, 0.9)], "query_id long, doc_id long, score double")
    top = ranking.top_k(scored, 3)
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [9, 3, 7]
    assert [r.doc_id for r in ranking.page(top, 1, 2).collect()] == [7]
    assert rows(ranking.top_k(scored, 2), "doc_id") == [(3,), (9,)]
    assert ranking.top_k(scored, 1, by=None).first().doc_id == 9


def test_weights_and_fusion(spark):
    assert [ranking.weight(w) for w in (60, 1, 0.4)] == [0.6, 1, 0.4]
    text = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5)], "query_id long, doc_id long, score double")
    image = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.2)], "query_id long, doc_id long, score double")
    assert {r.doc_id: round(r.score, 6) for r in ranking.fuse(text, image, 60, 40).collect()} == {1: 0.6, 2: 0.7, 3: 0.08}
    assert {r.doc_id for r in ranking.fuse(text, image, 60, 40, truncate=1).collect()} == {1, 2}
    assert {r.score for r in ranking.min_max(text).collect()} == {0.0, 1.0}


def test_percentage_truncates(spark):
    assert spark.range(1).select(ranking.percentage(F.lit(0.999)).alias("p")).first().p == "99%"


def test_engine(spark, products, tmp_path):
    vectors = spark.createDataFrame([(d, [float(d == i) for i in range(1, 5)]) for d in range(1, 5)], "doc_id long, embedding array<double>")
    engine = Engine.build(spark, products, vectors, np.eye(4), stop_words=("men",))
    found = engine.search_text("navy blue shirts").collect()
    assert found[0].doc_id == 1 and found[0].sub_category == "Topwear" and found[0].rank == 1
    assert engine.search_text("men").count() == 0  # the stop word
    assert [r.doc_id for r in engine.search_text("silver watch", engine="postgres").collect()] == [3]
    assert engine.search_text("silver jeans", engine="postgres").count() == 0  # all terms must match
    image = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert engine.search(images=image).first().doc_id == 2
    both = engine.search(tables.query_frame(spark, ["navy shirt"]), image, weights=(10, 90)).collect()
    assert both[0].doc_id == 2 and {r.doc_id for r in both} == {1, 2} | {r.doc_id for r in both}
    assert engine.search().count() == 0 and engine.search_text("  ").count() == 0
    assert [r.doc_id for r in engine.search_text("navy blue shirts", engine="other").collect()] == [r.doc_id for r in found]  # the inverted index
    assert engine.search(images=image, engine="postgres", approximate=True).first().doc_id == 2
    built = Engine.build(spark, products, vectors, np.eye(4), stop_words=("men",), path=str(tmp_path))
    for other in (built, Engine.read(spark, str(tmp_path))):  # from the files alone
        assert [r.doc_id for r in other.search_text("navy blue shirts").collect()] == [r.doc_id for r in found]
        assert other.search_text("men").count() == 0 and other.search(images=image).first().doc_id == 2
        assert other.search_text("silver watch", engine="postgres").first().doc_id == 3
        assert other.search(images=image, engine="postgres", approximate=True).first().doc_id == 2
    textual = Engine.build(spark, products)
    textual.write(str(tmp_path))
    assert Engine.read(spark, str(tmp_path)).search_text("watch").first().doc_id == 3
    assert engine.details(3).first().attributes.product_name == "Titan Women Silver Watch" and engine.details(99).count() == 0


def test_format(spark, products):
    ranked = spark.createDataFrame([(0, 1, 4, 0.5), (0, 2, 77, 0.25)], "query_id long, rank long, doc_id long, score double")
    out = {r.id: r for r in formatted(enriched(ranked, products)).collect()}
    assert out["4"].match_percentage == "50%" and out["77"].name == "Unknown" and out["77"].image_url is None


def test_precision_recall(spark):
    ranked = spark.createDataFrame([(0, d, d + 1) for d in range(10)], "query_id long, doc_id long, rank long")
    labels = spark.createDataFrame([(d, "a" if d < 3 or d > 90 else "b") for d in range(100)], "doc_id long, label string")
    expected = spark.createDataFrame([(0, "a"), (1, "a"), (2, "zzz"), (3, "")], "query_id long, label string")
    got = {r.query_id: (r.precision, round(r.recall, 6)) for r in evaluate.precision_recall(ranked, labels, expected, 50).collect()}
    assert got == {0: (0.06, 0.25), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_vectors(spark):
    centres = np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 5.0]])
    near = spark.createDataFrame([([0.1, 0.0],), ([4.0, 4.0],)], "v array<double>").select(nearest_codeword(F.col("v"), centres).alias("c"))
    assert [r.c for r in near.collect()] == [0, 2]
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, vector array<double>")
    assert rows(knn.knn_exact(data, q, 5), "doc_id", "score") == [(1, 1.0), (4, 0.707107)]
    lists = knn.assign_lists(data.where("embedding is not null"), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert rows(knn.knn_ivf(lists, q, np.array([[1.0, 0.0], [0.0, 1.0]]), 5, probes=2), "doc_id") == [(1,), (4,)]
    assert index.kmeans_codebook(data.where("1 = 0"), 3).size == 0


def test_patches(spark):
    image = np.arange(100 * 100).reshape(100, 100)
    tiles = patches(image)
    assert len(tiles) == 4 and all(t.shape == (80, 64) for t in tiles)
    assert (tiles[0] == image[:80, :64]).all() and tiles[3][-1, -1] == 0 and tiles[1][0, 0] == 64
    assert len(patches(np.ones((80, 64, 3)))) == 1 and grey(np.ones((2, 2, 3))).shape == (2, 2)
    assert len(patches(np.ones((8, 8)), (4, 4), (2, 2))) == 9
    with pytest.raises(ValueError, match="overlap"):
        patches(image, overlap=(80, 0))
    frame = spark.createDataFrame([(1, bytearray(b"\x02")), (2, None), (3, bytearray(b""))], "doc_id long, content binary")
    out = descriptors(frame, lambda b: np.full((80, 65), b[0]) if b else None, lambda tile: [tile[0, :2]])
    assert rows(out, "doc_id", "patch") == [(1, 0), (1, 1)]


def test_updates(spark):
    old = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t2")], "doc_id long, url string, text string")
    new = spark.createDataFrame([(1, "", "t9"), (3, "u3", "")], "doc_id long, url string, text string")
    assert rows(sinks.upsert(old, new), "doc_id", "url", "text") == [(1, "u1", "t9"), (2, "u2", "t2"), (3, "u3", "")]
    batch = spark.createDataFrame([(1, "a", "x", 1), (1, "", "y", 2)], "doc_id long, url string, text string, seq long")
    assert rows(sinks.latest(batch, "seq"), "doc_id", "url", "text") == [(1, "a", "y")]
    h = spark.createDataFrame([(1, [1.0, 2.0]), (9, [0.0, 0.0])], "doc_id long, histogram array<double>")
    assert rows(sinks.set_histograms(old, h, "image_histogram", 2), "doc_id", "image_histogram") == [(1, [1.0, 2.0]), (2, None)]
    with pytest.raises(Exception, match="must have 3"):
        sinks.set_histograms(old, h, "image_histogram", 3).collect()


def test_files(spark, tmp_path):
    (tmp_path / "styles.csv").write_text('id,texto\n2,b\n1,"a, ""q"""\n')
    assert rows(tables.read_text_corpus(spark, str(tmp_path / "styles.csv"), 1), "doc_id", "text") == [(1, 'a, "q"')]
    (tmp_path / "raw.csv").write_text("id,gender\n5,Men,A,B,C,Red,Fall,2011.0,Casual,Shirt, blue\n6,Men,A,B,C,,Fall,,Casual,Hat\n")
    assert rows(tables.read_products(spark, str(tmp_path / "raw.csv")), "doc_id", "text") == [(5, "Men|A|B|C|Red|Fall|2011.0|Casual|Shirt, blue"), (6, "Men|A|B|C|nan|Fall|nan|Casual|Hat")]
    (tmp_path / "images.csv").write_text("filename,link\n7.jpg,http://x\n8.jpg,undefined\n")
    links = tables.read_image_links(spark, str(tmp_path / "images.csv"))
    assert rows(links, "doc_id") == [(7,)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/7.jpg").write_bytes(b"x")
    (tmp_path / "img/9.jpg").write_bytes(b"y")
    assert rows(tables.read_images(spark, str(tmp_path / "img"), links, 5), "doc_id") == [(7,)]
    (tmp_path / "stop.txt").write_text("The\n and \n\nthe\n")
    assert tables.read_stop_words(spark, str(tmp_path / "stop.txt")) == ["and", "the"] and tables.read_stop_words(spark, str(tmp_path / "none.txt")) == []
    dump = spark.createDataFrame([(1, "u", 'x "y", z', [0.5, 1.0], None)], "doc_id long, url string, texto string, image_histogram array<float>, text_histogram array<float>")
    sinks.dump_csv(dump, str(tmp_path / "dump"))
    back = tables.read_descriptors(spark, str(tmp_path / "dump"))
    assert back.collect() == dump.collect() and tables.vector_size(back, "image_histogram") == 2 and tables.vector_size(back, "text_histogram") is None
    assert tables.read_descriptors(spark, str(tmp_path / "dump"), ["doc_id"]).columns == ["doc_id"]
    assert sinks.disk_mb(spark, str(tmp_path / "dump")) >= 0 and not tables.has_rows(spark, "no_such_table")


def test_stream(spark, tmp_path):
    from vitrine.streaming.incremental import frequencies, maintain

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(source)
    for _ in range(2):
        maintain(spark.readStream.schema("doc_id long, text string").parquet(source), out, mark).awaitTermination()
        spark.createDataFrame([(1, "b"), (2, "c")], "doc_id long, text string").write.mode("append").parquet(source)
    assert rows(frequencies(spark, out), "doc_id", "term", "tf") == [(1, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_statistics(spark):
    tf = spark.createDataFrame([(d, t, n) for d, t, n in [(1, "a", 5), (2, "a", 2), (1, "b", 1), (2, "c", 3)]], "doc_id long, term string, tf long")
    assert evaluate.bow_stats(tf).first().asDict() == {"vocabulary": 3, "occurrences": 11, "hapax": 1, "hapax_pct": 33.33}
    assert rows(evaluate.coverage_curve(tf, (1, 2, 10)), "k", "coverage_pct") == [(1, 63.64), (2, 90.91), (10, 100.0)]
    assert dict(rows(evaluate.frequency_buckets(tf), "bucket", "terms")) == {"1": 1, "2-5": 1, "6-20": 1, "21-100": 0, "101-1000": 0, "1001+": 0}


def test_histograms(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    assert rows(index.vocabulary(d), "word_id", "term") == [(0, "b"), (1, "a"), (2, "c")]
    book = index.text_codebook(d, 2)
    assert rows(book, "codeword_id", "term", "cf") == [(0, "b", 2), (1, "a", 2)]
    tf = index.codewords(index.term_frequencies(d), book)
    assert rows(index.dense(tf, 3), "doc_id", "histogram") == [(1, [2.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0])]
    assert rows(index.posting_lists(index.term_frequencies(d)).where("term = 'a'"), "postings") == [([(1, 1), (2, 1)],)]
    assert rows(index.posting_lists(index.term_frequencies(d), span=2).where("term = 'a'"), "block", "postings") == [(0, [(1, 1)]), (1, [(2, 1)])]
    with pytest.raises(Exception, match="outside"):
        index.dense(tf, 1).collect()


def test_knn_exact_takes_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    q = data.selectExpr("doc_id as query_id", "embedding as vector")
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    out = {(r.query_id, r["rank"]): r.doc_id for r in knn.knn_exact(data, q, 5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(unit @ unit.T), axis=1)[:, :5]
    assert out == {(i, n + 1): near[i, n] for i in range(60) for n in range(5)}


@pytest.mark.parametrize("approximate", ["ivf", "lsh"])
def test_recall_of_approximate_search(spark, approximate):
    """Against exact search, on the driver's vectors, every twentieth a query."""
    found = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    asked = found.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "embedding AS vector")
    if approximate == "ivf":
        centres = np.array([r.embedding for r in found.where("doc_id < 10").orderBy("doc_id").collect()], np.float64)
        near = knn.knn_ivf(knn.assign_lists(found, centres), asked, centres, 10, probes=8)
    else:
        near = knn.knn_lsh(knn.with_signatures(found), asked, 10, candidates=200)
    exact = {(r.query_id, r.doc_id) for r in knn.knn_exact(found, asked, 10).collect()}
    assert len({(r.query_id, r.doc_id) for r in near.collect()} & exact) >= 0.9 * len(exact)


def test_vocabulary_over_ranges(spark):
    docs = spark.createDataFrame([(200_000, "new old"), (None, "first"), (3, "old older"), (70_000, "older newest x")], "doc_id long, text string")
    assert [r.term for r in sorted(index.vocabulary(docs).collect(), key=lambda r: r.word_id)] == ["first", "old", "older", "newest", "x", "new"]


def test_many_query_weights(spark, products):
    """Weights beyond what is sent to the scan are joined."""
    tf = index.term_frequencies(products)
    built = index.build_index(tf, 4)
    asked = tf.withColumnRenamed("doc_id", "query_id")
    found = [{(r.query_id, r.doc_id): round(r.score, 9) for r in index.score(built, asked, *how).collect()} for how in ((), (True, 1000), (True, 3))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 4


def test_command_line(spark, tmp_path, capsys):
    from vitrine.__main__ import main

    sinks.dump_csv(spark.createDataFrame([(r[0], r[2]) for r in RECORDS], "id long, texto string"), str(tmp_path / "corpus"))
    (tmp_path / "stop").write_text("men\nMEN\n")
    spark.createDataFrame([(d, [float(d == i) for i in range(1, 5)]) for d in range(1, 5)], "doc_id long, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "codeword_id long, centre array<double>").write.parquet(str(tmp_path / "centres"))
    main(["build", str(tmp_path / "corpus"), str(tmp_path / "engine"), "--stop-words", str(tmp_path / "stop"), "--vectors", str(tmp_path / "vectors"), "--centres", str(tmp_path / "centres")], spark)
    assert main(["search", str(tmp_path / "engine"), "--text", "silver watch", "-k", "1"], spark)[0].id == "3"
    assert main(["search", str(tmp_path / "engine"), "--vector", "0,1,0,0"], spark)[0].id == "2"
    assert main(["search", str(tmp_path / "engine"), "--text", "men"], spark) == []
    assert "Titan Women Silver Watch" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["search", str(tmp_path / "engine")], spark)


def test_measured_runs(spark, products, tmp_path):
    from vitrine.plans import benchmark

    engine = Engine.build(spark, products)
    labels = products.selectExpr("doc_id", "split(text, '[|]')[2] AS label")
    cases = [(4, "text", q, "spimi", lambda q=q: engine.search_text(q, 50)) for q in ("silver watch", "navy", "zzz")]
    runs = benchmark.measured(spark, cases, labels, {"silver watch": "Watches", "navy": "Topwear"})
    out = {r.query: r for r in runs.collect()}
    assert out["silver watch"].precision == 1 / 50 and out["silver watch"].recall == 1 and out["navy"].recall == 0.5
    assert out["zzz"].io == 0 and out["zzz"].recall == 0 and all(r.latencia > 0 for r in out.values())
    assert benchmark.averaged(runs).first().io_avg == sum(r.io for r in out.values()) / 3
    engine.write(str(tmp_path))
    assert benchmark.disk(spark, {"texto_mb": f"{tmp_path}/text"}).columns == ["texto_mb"]


def test_strict_decoding(spark):
    images = spark.createDataFrame([(1, bytearray(b"no image"))], "doc_id long, content binary")
    assert descriptors(images, lambda b: None, lambda m: m).count() == 0
    with pytest.raises(Exception, match="cannot be decoded"):
        descriptors(images, lambda b: None, lambda m: m, strict=True).collect()


def test_proximity(spark):
    """Against the definition, place by place: stop words leave gaps, equal stems are one lexeme."""
    import math
    import random

    r = random.Random(4)
    words = ["red", "shirts", "shirt", "the", "blue", "watch", "x1"]
    texts = [" ".join(r.choices(words, k=r.choice([3, 20, 400]))) for _ in range(60)] + ["", None, "red " + "pad " * 150 + "watch", "RED, red; Red"]
    postings = fulltext.positions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["the"], stemmed=True)
    queries = ["red shirt", "shirts", "the", "", "red the blue watch", "red unseen", "watch red"]
    asked = fulltext.query_lexemes(tables.query_frame(spark, queries), ["the"], stemmed=True)
    found = {(x.query_id, x.doc_id): x.score for x in fulltext.search_near(postings, asked).collect()}

    def lexemes(text):
        return [(i, w.removesuffix("s")) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if w != "the"]

    want = {}
    for q, query in enumerate(queries):
        terms = {w for _, w in lexemes(query)}
        for d, text in enumerate(texts):
            places = [(i, w) for i, w in lexemes(text) if w in terms]
            if not terms or {w for _, w in places} != terms:
                continue
            if len(terms) == 1:
                want[q, d] = 0.1 * sum(1 / (n + 1) ** 2 for n in range(len(places))) / 1.64493406685
            else:
                rest = 1.0
                for i, (a, v) in enumerate(places):
                    for b, w in places[i + 1 :]:
                        if v != w and b - a <= 100:
                            rest *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp((b - a) / 1.5 - 2)))
                want[q, d] = 1 - rest
    assert found.keys() == want.keys() and len(want) > 40
    assert all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_query_by_idf_at_hand(spark, products, monkeypatch):
    """The same rows with the idf at hand, with too many codewords to keep, and with too many query terms."""
    built = build_index(term_frequencies(products.select("doc_id", "text")), 4)
    tf = term_frequencies(tables.query_frame(spark, ["navy blue shirts unseen", "silver watch watch", ""]), key="query_id")
    want = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in score(built, tf).collect())
    rows = lambda **o: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in score(built, tf, lookup=True, **o).collect())
    assert rows() == want and built.kept
    assert rows(most=2) == want
    built.kept = None
    monkeypatch.setattr("vitrine.operators.index.MOST_KEPT", 2)
    assert rows() == want and not built.kept


def test_graph_finds_nine_tenths_for_a_tenth_of_the_work(spark, tmp_path):
    r = np.random.default_rng(7)
    x = r.normal(size=(6000, 12)) @ r.normal(size=(12, 48)) + 0.3 * r.normal(size=(6000, 48))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    asked = vectors.where("doc_id % 40 = 0").selectExpr("doc_id AS query_id", "embedding AS vector")
    exact = {(r.query_id, r.doc_id): r.score for r in knn.knn_exact(vectors, asked, 10).collect()}
    for shard, share in ((6000, 0.1), (2000, 0.2)):  # in three shards there is three times the searching
        graph.write_graph(graph.build_graph(vectors, shard=shard), path := str(tmp_path / str(shard)))
        found = graph.knn_graph(spark.read.parquet(path), asked, 10).collect()
        assert len(found) == len(exact) and {r.rank for r in found} == set(range(1, 11))
        same = [r for r in found if (r.query_id, r.doc_id) in exact]
        assert len(same) >= 0.9 * len(exact) and all(abs(r.score - exact[r.query_id, r.doc_id]) < 1e-5 for r in same)
        assert max(r.compared for r in found) < share * len(x)


def test_graph_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0]), (4, [0.0, 2.0]), (5, [-1.0, 0.0])]
    built = graph.build_graph(spark.createDataFrame(rows, "doc_id long, embedding array<double>"))
    asked = spark.createDataFrame([(0, [0.1, 1.0]), (1, [0.0, 0.0])], "query_id long, vector array<double>")
    assert [r.doc_id for r in graph.knn_graph(built, asked, 10).orderBy("rank").collect()] == [4, 4, 1, 5]
    assert [r.doc_id for r in graph.knn_graph(built, asked, 1).collect()] == [4]
    alone = graph.build_graph(spark.createDataFrame(rows[:1], "doc_id long, embedding array<double>"))
    assert [(r.doc_id, r.compared) for r in graph.knn_graph(alone, asked, 3).collect()] == [(1, 2)]
    empty = graph.build_graph(spark.createDataFrame([], "doc_id long, embedding array<double>"))
    assert graph.knn_graph(empty, asked, 3).collect() == [] and graph.knn_graph(built, asked.limit(0), 3).collect() == []
