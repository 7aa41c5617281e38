"""Incremental upkeep of term frequencies from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import add_postings, term_frequencies


def merge_batch(path: str):
    """A function for ``foreachBatch``: each batch's frequencies are one version of their own.

    A batch that is run again after a failure overwrites its own folder, so
    nothing counts twice; ``frequencies`` adds the versions up.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        term_frequencies(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def frequencies(spark, path: str) -> DataFrame:
    found = spark.read.parquet(path).select("term", "doc_id", "tf")
    return add_postings(found, found.limit(0))


def maintain(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the upkeep of ``path`` from a streaming DataFrame of doc_id and text, up to what is there now."""
    return documents.writeStream.foreachBatch(merge_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
