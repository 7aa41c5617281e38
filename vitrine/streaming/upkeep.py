"""Descriptors, histograms and postings kept up together from a stream of new and changed documents.

A batch writes what it changes under its own number: the records as they came,
and signed differences of frequencies, so a changed document takes back what its
old version counted. Reading adds up. What a batch writes depends on the batches
before it alone, so a batch that failed half way can run again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, build_index, dealt, term_frequencies, visual_frequencies, write_index
from ..sources.sinks import latest, write_table

#: Tables of a store, with the schema of what a batch writes. ``held`` is 1 where a term comes into a document and -1 where
#: it goes; a document frequency without a term counts documents.
TABLES = {
    "descriptors": "doc_id long, url string, text string",
    "frequencies": "term string, doc_id long, tf long, held long",
    "document_frequencies": "term string, df long",
    "visual": "codeword_id long, doc_id long, tf long",
}
#: What tells the rows of a table apart, and what is added up.
SUMS = {"frequencies": (["term", "doc_id"], "tf"), "document_frequencies": (["term"], "df"), "visual": (["codeword_id", "doc_id"], "tf")}
#: Rows that a task adds up on average at most; nearly all are apart, so that it holds about as many sums.
MOST_SUMMED = 2_000_000


@dataclass
class Store:
    """Tables at ``path``, one writer at a time. With ``centres`` descriptors of images are kept up too."""

    spark: SparkSession
    path: str
    centres: np.ndarray | None = None
    stop_words: tuple[str, ...] = ()
    stemmed: bool = False

    @staticmethod
    def create(spark: SparkSession, path: str, centres: np.ndarray | None = None, stop_words: tuple[str, ...] = (), stemmed: bool = False) -> Store:
        """A store without documents, in place of none: what is there already stays."""
        store = Store(spark, path, centres, stop_words, stemmed)
        for name, schema in TABLES.items():
            write_table(spark.createDataFrame([], schema), f"{path}/{name}/changes/batch=-1")
        spark.createDataFrame([(-1,)], "through long").write.mode("append").parquet(f"{path}/compacted")
        return store

    def through(self) -> int:
        """The batch up to which changes are summed up in tables of their own."""
        return self.spark.read.parquet(f"{self.path}/compacted").agg(F.max("through")).first()[0]

    def _read(self, name: str, before: int | None) -> DataFrame:
        """What batches, those before a number if one is given, have written: the compacted part and each later change."""
        through = self.through()
        rows = self.spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{self.path}/{name}/changes").where(F.col("batch") > through)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if through >= 0:
            rows = rows.unionByName(self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/through={through}").withColumn("batch", F.lit(through).cast("long")))
        return rows

    def _sum(self, name: str, before: int | None = None) -> DataFrame:
        keys, number = SUMS[name]
        rows = self._read(name, before)
        return dealt(rows, keys[-1], -(-rows.count() // MOST_SUMMED)).groupBy(*keys).agg(F.sum(number).alias(number)).where(F.col(number) != 0)

    def descriptors(self, before: int | None = None) -> DataFrame:
        """doc_id, url and text of every document: of each column the last value that is not empty."""
        return latest(self._read("descriptors", before), "batch")

    def frequencies(self, before: int | None = None) -> DataFrame:
        return self._sum("frequencies", before)

    def visual(self, before: int | None = None) -> DataFrame:
        return self._sum("visual", before)

    def document_frequencies(self) -> DataFrame:
        """term and df, without the number of documents."""
        return self._sum("document_frequencies").where("term IS NOT NULL")

    def size(self) -> int:
        """How many documents there are, empty ones included."""
        return self._sum("document_frequencies").where("term IS NULL").agg(F.sum("df")).first()[0] or 0

    def index(self, path: str | None = None) -> Index:
        """The inverted index of the texts as they are now, written at ``path`` if one is given. Norms follow from it, as every new document changes each idf."""
        return build_index(self.frequencies(), self.size()) if path is None else write_index(self.frequencies(), self.size(), path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in a batch, for ``foreachBatch``.

        ``batch``: doc_id, url, text, ``order``, which of several rows of a document
        is later, and, where there are centres, ``vectors``, the image's descriptors or
        null. An empty url or text, and null vectors, leave what there is; a text
        without tokens takes all postings back. Rows without a doc_id go. A batch
        that has been compacted is not taken in again.
        """
        if batch_id <= self.through():
            return
        batch = batch.where("doc_id IS NOT NULL")
        self._write("descriptors", batch_id, latest(batch, "order"))
        came = self.spark.read.parquet(f"{self.path}/descriptors/changes/batch={batch_id}")
        earlier = self._read("descriptors", batch_id).select("doc_id").distinct()
        texts = came.where("text != ''").select("doc_id", "text")
        fresh = self._count(texts.join(earlier, "doc_id", "left_anti")).select("term", "doc_id", "tf", F.lit(1).cast("long").alias("held"))
        known = texts.join(earlier, "doc_id", "left_semi")
        changes = _changes(self.frequencies(batch_id), self._count(known), known, "term")
        held = (F.col("new") > 0).cast("long") - (F.col("old") > 0).cast("long")
        changed = changes.select("term", "doc_id", (F.col("new") - F.col("old")).alias("tf"), held.alias("held")).where("tf != 0")
        self._write("frequencies", batch_id, fresh.unionByName(changed))
        wrote = self.spark.read.parquet(f"{self.path}/frequencies/changes/batch={batch_id}")
        by_term = wrote.groupBy("term").agg(F.sum("held").alias("df")).where("df != 0")
        first = came.join(earlier, "doc_id", "left_anti").agg(F.count("*").alias("df")).select(F.lit(None).cast("string").alias("term"), "df")
        self._write("document_frequencies", batch_id, by_term.unionByName(first))
        if self.centres is not None:
            seen = batch.where("vectors IS NOT NULL").groupBy("doc_id").agg(F.max_by("vectors", "order").alias("vectors"))
            visual = visual_frequencies(seen.select("doc_id", F.explode("vectors").alias("embedding")), self.centres)
            changes = _changes(self.visual(batch_id), visual, seen, "codeword_id")
            self._write("visual", batch_id, changes.select("codeword_id", "doc_id", (F.col("new") - F.col("old")).alias("tf")).where("tf != 0"))

    def _count(self, texts: DataFrame) -> DataFrame:
        return term_frequencies(texts, list(self.stop_words), self.stemmed)

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        write_table(rows, f"{self.path}/{name}/changes/batch={batch_id}")

    def compact(self, through: int) -> None:
        """Sums up the batches up to a number. Readers see the new tables once all are written, as the number is noted last."""
        if through <= self.through():
            return
        write_table(self.descriptors(through + 1), f"{self.path}/descriptors/through={through}")
        for name in SUMS:
            write_table(self._sum(name, through + 1), f"{self.path}/{name}/through={through}")
        self.spark.createDataFrame([(through,)], "through long").write.mode("append").parquet(f"{self.path}/compacted")

    def maintain(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts taking in a streaming DataFrame of batches, up to what is there now."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(old: DataFrame, new: DataFrame, documents: DataFrame, codeword: str) -> DataFrame:
    """codeword, doc_id, old and new frequency in the documents that change."""
    before = old.join(documents.select("doc_id"), "doc_id", "left_semi").select(codeword, "doc_id", F.col("tf").alias("old"), F.lit(0).cast("long").alias("new"))
    after = new.select(codeword, "doc_id", F.lit(0).cast("long").alias("old"), F.col("tf").alias("new"))
    return before.unionByName(after).groupBy(codeword, "doc_id").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
