"""Indexes and records in buckets, so that searches move queries and hits and leave the tables where they are.

A table is dealt by its key into a fixed number of files and sorted in them when
it is written. A join on that key then sends the other side to the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .index import Index


def write_bucketed(table: DataFrame, name: str, path: str, key: str, buckets: int, *then: str) -> DataFrame:
    """Writes ``table`` at ``path`` in buckets of ``key``, sorted by it and ``then``, under a name in the session's catalog.

    ``buckets`` should be the shuffle partitions of later searches or more: a join
    with more partitions than buckets would move the table after all.
    """
    spark = table.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    table.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *then).saveAsTable(name)
    return spark.table(name)


def write_index_bucketed(index: Index, name: str, path: str, buckets: int) -> Index:
    """The index with its postings in buckets of the codeword; idf and norms are plain tables."""
    postings = write_bucketed(index.postings, f"{name}_postings", f"{path}/postings", index.codeword, buckets, "doc_id")
    index.idf.write.mode("overwrite").parquet(f"{path}/idf")
    index.norms.write.mode("overwrite").parquet(f"{path}/norms")
    spark = postings.sparkSession
    return Index(postings, spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/norms"), index.codeword, by_document=False)


def attach(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int, *then: str) -> DataFrame:
    """A table that another session has written with ``write_bucketed``, known to this one's catalog."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join([key, *then])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
