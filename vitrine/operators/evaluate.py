"""Retrieval quality and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the coverage curve and lower ends of the frequency buckets (fixed values).
COVERAGE = (10, 50, 100, 200, 500, 1000, 2000, 5000)
BUCKETS = ((1, "1"), (2, "2-5"), (6, "6-20"), (21, "21-100"), (101, "101-1000"), (1001, "1001+"))


def label_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of each label among ``docs``."""
    return docs.select(key).join(labels.select(key, "label"), key).groupBy("label").agg(F.count("*").alias("n"))


def precision_recall(ranked: DataFrame, labels: DataFrame, expected: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, precision and recall of each query at k.

    ``ranked``: query_id, key, rank; ``expected``: query_id and the label that
    counts. Precision divides by k even where fewer were returned; an empty or
    unknown label, or an empty result, gives 0.
    """
    totals = labels.groupBy("label").agg(F.count("*").alias("total"))
    wanted = expected.select("query_id", F.col("label").alias("wanted")).join(totals.withColumnRenamed("label", "wanted"), "wanted", "left")
    hits = ranked.where(F.col("rank") <= k).join(labels.select(key, "label"), key).join(wanted.select("query_id", "wanted"), "query_id").where((F.col("label") == F.col("wanted")) & (F.col("wanted").cast("string") != ""))
    counted = wanted.join(hits.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    recall = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))
    return counted.select("query_id", (F.col("hits") / F.lit(k)).alias("precision"), recall.alias("recall"))


def averages(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.avg(m).alias(f"{m}_avg") for m in metrics)).orderBy(*by)


def corpus_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"))


def bow_stats(tf: DataFrame) -> DataFrame:
    """Vocabulary, occurrences, terms seen once and their percentage, in one row."""
    once = F.count(F.when(F.col("cf") == 1, 1))
    return corpus_frequency(tf).agg(
        F.count("*").alias("vocabulary"), F.coalesce(F.sum("cf"), F.lit(0)).alias("occurrences"), once.alias("hapax"), F.round(once * 100.0 / F.count("*"), 2).alias("hapax_pct")
    )


def coverage_curve(tf: DataFrame, ranks: tuple[int, ...] = COVERAGE) -> DataFrame:
    """k and the percentage of occurrences that the k most frequent terms make up.

    Frequencies are counted by value first, so the running sum is over distinct
    frequencies and not over the vocabulary.
    """
    by_value = corpus_frequency(tf).groupBy("cf").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by_value.select("cf", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    k = F.explode(F.array(*(F.lit(r).cast("long") for r in ranks))).alias("k")
    part = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("above"))) * F.col("cf")
    return steps.select("cf", "n", "above", k).groupBy("k").agg(F.round(F.sum(part) * 100.0 / F.sum(F.col("n") * F.col("cf")), 2).alias("coverage_pct"))


def frequency_buckets(tf: DataFrame) -> DataFrame:
    """Terms of each range of frequencies, 0 where there are none."""
    spark = tf.sparkSession
    name = F.lit(None).cast("string")
    for low, label in BUCKETS:
        name = F.when(F.col("cf") >= low, label).otherwise(name)
    found = corpus_frequency(tf).groupBy(name.alias("bucket")).agg(F.count("*").alias("terms"))
    every = spark.createDataFrame([(label,) for _, label in BUCKETS], "bucket string")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("terms", F.lit(0)).alias("terms"))
