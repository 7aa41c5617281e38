"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built once and written; searches run over the written tables, a
batch of queries at a time, as a batch engine is used. ``qps`` is queries of the
batch over its seconds. Each search is timed after one warm-up run.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from vitrine import queries as Q  # noqa: E402
from vitrine.operators import evaluate, fulltext, index, knn, ranking  # noqa: E402

K = 50


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work, took, rate = tempfile.mkdtemp(prefix="vitrine-bench-"), {}, {}

    def timed(name, run, n=None, warm=True):
        if warm:
            run()
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 4)
        if n:
            rate[name] = round(n / took[name], 1)

    def collect(df):
        return df.write.format("noop").mode("overwrite").save()

    docs, vectors = Q.docs(spark, sf_dir), Q.vectors(spark, sf_dir)
    n_docs = docs.count()

    def build_text():
        index.term_occurrences(docs).write.mode("overwrite").parquet(f"{work}/tf")  # read by each pass of the build
        tf = spark.read.parquet(f"{work}/tf")
        index.codebook_of(tf).select("term").write.mode("overwrite").parquet(f"{work}/codebook")
        index.write_index(tf.join(spark.read.parquet(f"{work}/codebook"), "term"), n_docs, f"{work}/text")

    timed("build_text_index", build_text, warm=False)
    centres = Q.centres(spark, sf_dir, 64)
    images = vectors.selectExpr("doc_id div 5 AS doc_id", "embedding")

    def build_image():
        index.visual_frequencies(images, centres).write.mode("overwrite").parquet(f"{work}/visual")
        index.write_index(spark.read.parquet(f"{work}/visual"), images.select("doc_id").distinct().count(), f"{work}/image", "codeword_id")

    timed("build_image_index", build_image, warm=False)
    text, image = index.Index.read(spark, f"{work}/text"), index.Index.read(spark, f"{work}/image")
    asked = Q.query_tf(Q.benchmark(spark, sf_dir)).cache()
    n_text = Q.benchmark(spark, sf_dir).count()
    one = Q.query_tf(Q.benchmark(spark, sf_dir, "item_id = 0")).cache()
    asked.count(), one.count()
    probe = Q.vector_queries(spark, sf_dir, "doc_id % 20 = 0").cache()
    n_probe = probe.count()
    visual = index.visual_frequencies(images.where("doc_id < 50").withColumnRenamed("doc_id", "query_id"), centres, key="query_id").cache()
    n_visual = visual.select("query_id").distinct().count()

    timed("text_search_one", lambda: collect(ranking.top_k(index.score(text, one, lookup=True), K)), 1)
    timed("text_search_batch", lambda: collect(ranking.top_k(index.score(text, asked), K)), n_text)
    timed("text_scan_batch", lambda: collect(ranking.top_k(index.score_linear(text.postings.select("term", "doc_id", "tf"), asked, n_docs), K)), n_text, warm=False)
    timed("fulltext_batch", lambda: collect(ranking.top_k(fulltext.search_all(text, asked), K)), n_text)
    timed("image_search_batch", lambda: collect(ranking.top_k(index.score(image, visual), K)), n_visual)
    timed("knn_exact_batch", lambda: collect(knn.knn_exact(vectors, probe, K)), n_probe)
    lists = Q.centres(spark, sf_dir, Q.LISTS)
    knn.assign_lists(vectors, lists).write.partitionBy("list_id").parquet(f"{work}/ivf")
    ivf = spark.read.parquet(f"{work}/ivf")
    timed("knn_ivf_batch", lambda: collect(knn.knn_ivf(ivf, probe, lists, K, probes=8)), n_probe)
    near = knn.knn_exact(vectors, probe, 1000).drop("rank").cache()
    timed("fused_batch", lambda: collect(ranking.top_k(ranking.fuse(index.score(text, asked), near, 60, 40, truncate=1000), K)), n_text)
    timed("precision_recall", lambda: collect(evaluate.precision_recall(knn.knn_exact(vectors, probe, K), vectors, probe.join(vectors.selectExpr("doc_id AS query_id", "label"), "query_id"), K)), n_probe)
    timed("corpus_statistics", lambda: collect(evaluate.coverage_curve(index.term_frequencies(docs))))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "qps": rate, "docs": n_docs, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
