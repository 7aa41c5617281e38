"""The search engine's facade: build, search by text, vectors or both, and format results."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk import chunk_rows
from ..functions.text import FIELDS, unpack_record
from ..functions.vectors import matrix
from ..operators.fulltext import positions, query_lexemes, search_near
from ..operators.graph import build_graph, knn_graph, write_graph
from ..operators.index import Index, score, term_frequencies, visual_frequencies, write_index
from ..operators.knn import knn_exact, knn_lsh, with_signatures
from ..operators.ranking import fuse, percentage, top_k
from ..sources.sinks import scratch_path, write_table
from ..sources.tables import query_frame

DATABASE_CUT = 1000


@dataclass
class Engine:
    """Indexes of one corpus. ``descriptors``: doc_id, url, text of each product; ``vectors``: doc_id, embedding;
    ``lexemes``: positional postings of whole texts, for full-text search; ``graph``: layered graphs of the vectors,
    which an engine on disk has, for approximate search."""

    spark: SparkSession
    descriptors: DataFrame
    text: Index
    image: Index | None = None
    vectors: DataFrame | None = None
    centres: np.ndarray | None = None
    stop_words: tuple[str, ...] = ()
    stemmed: bool = True
    chunked: bool = True
    lexemes: DataFrame | None = None
    graph: DataFrame | None = None

    @staticmethod
    def build(
        spark: SparkSession,
        descriptors: DataFrame,
        vectors: DataFrame | None = None,
        centres: np.ndarray | None = None,
        terms: int = 1000,
        stop_words: tuple[str, ...] = (),
        stemmed: bool = True,
        chunked: bool = True,
        n_docs: int | None = None,
        path: str | None = None,
    ) -> Engine:
        """Chunks, tokens, codebook and index of the texts, and visual words and index of the vectors.

        Each step is written once, and read by the next. With a ``path`` that is there, and the engine is that of the files. A
        later build goes to a new folder there; readers see it when all is written, and older ones stay.
        """
        tf = _frequencies(descriptors.select("doc_id", "text"), stop_words, stemmed, chunked, "doc_id")
        visual = visual_frequencies(vectors.where("embedding is not null"), centres) if vectors is not None and centres is not None else None
        n = n_docs or descriptors.count()

        def finished(text: Index, image: Index | None) -> Engine:
            return Engine(spark, descriptors, text, image, vectors, centres, tuple(stop_words), stemmed, chunked, positions(descriptors.select("doc_id", "text"), list(stop_words), stemmed))

        place = _place(spark, path) if path is not None else scratch_path(spark)
        write_table(tf, f"{place}/frequencies")
        kept = f"{place}/codebook"
        tf = spark.read.parquet(f"{place}/frequencies")
        write_table(_codebook(tf, terms), kept)
        text, image = write_index(tf.join(spark.read.parquet(kept), "term"), n, f"{place}/text"), None
        if visual is not None:
            write_table(visual, f"{place}/visual_frequencies")
            image = write_index(spark.read.parquet(f"{place}/visual_frequencies"), n, f"{place}/image", "codeword_id")
        if path is None:
            return finished(text, image)
        finished(text, image)._write_rest(place)
        _publish(spark, path, place)
        return Engine.read(spark, path)

    def write(self, path: str) -> None:
        """All that ``read`` needs, as ``build`` writes it: records, indexes with their codebook, vectors, centres and options."""
        place = _place(self.spark, path)
        self.text.write(f"{place}/text")
        if self.image is not None:
            self.image.write(f"{place}/image")
        self._write_rest(place)
        _publish(self.spark, path, place)

    def _write_rest(self, path: str) -> None:
        write_table(self.descriptors, f"{path}/descriptors")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write_table(self.lexemes.repartition(parts, "term").sortWithinPartitions("term", "doc_id"), f"{path}/lexemes")
        if self.vectors is not None:
            write_table(self.vectors, f"{path}/vectors")
            write_graph(self.graph if self.graph is not None else build_graph(self.vectors), f"{path}/graph")
        places = [] if self.centres is None else [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        write_table(self.spark.createDataFrame(places, "codeword_id long, centre array<double>"), f"{path}/centres")
        options = [(list(self.stop_words), self.stemmed, self.chunked, self.image is not None, self.vectors is not None)]
        write_table(self.spark.createDataFrame(options, "stop_words array<string>, stemmed boolean, chunked boolean, image boolean, vectors boolean"), f"{path}/options")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Engine:
        """The engine that was last written at ``path``, from its files alone."""
        path = _last_build(spark, path) or path
        has = spark.read.parquet(f"{path}/options").first()
        places = spark.read.parquet(f"{path}/centres").orderBy("codeword_id").collect()
        image = Index.read(spark, f"{path}/image") if has.image else None
        vectors = spark.read.parquet(f"{path}/vectors") if has.vectors else None
        graph = spark.read.parquet(f"{path}/graph") if has.vectors else None
        centres = matrix([r.centre for r in places]) if places else None
        return Engine(spark, spark.read.parquet(f"{path}/descriptors"), Index.read(spark, f"{path}/text"), image, vectors, centres, tuple(has.stop_words), has.stemmed, has.chunked, spark.read.parquet(f"{path}/lexemes"), graph)

    # scores

    def _query_tf(self, queries: DataFrame) -> DataFrame:
        return _frequencies(queries.select("query_id", "text"), self.stop_words, self.stemmed, self.chunked, "query_id")

    def text_scores(self, queries: DataFrame, engine: str = "spimi", few: bool = False) -> DataFrame:
        """``few``: the queries are one or a handful, whose weights are worth finding before the index is read."""
        if engine == "postgres":
            return search_near(self.lexemes, query_lexemes(queries, list(self.stop_words), self.stemmed))
        return score(self.text, self._query_tf(queries), lookup=few)

    def image_scores(self, queries: DataFrame, engine: str = "spimi", approximate: bool = False) -> DataFrame:
        """``queries``: query_id and vector, several rows for the descriptors of one image."""
        if engine == "postgres":
            if not approximate:
                found = knn_exact(self.vectors, queries, DATABASE_CUT)
            elif self.graph is not None:
                found = knn_graph(self.graph, queries, DATABASE_CUT).drop("compared")
            else:
                found = knn_lsh(with_signatures(self.vectors), queries, DATABASE_CUT, 4 * DATABASE_CUT)
            return found.drop("rank")
        tf = visual_frequencies(queries, self.centres, "vector", "query_id")
        return score(self.image, tf)

    # searches

    def search(self, texts: DataFrame | None = None, images: DataFrame | None = None, k: int = 10, weights: tuple[float, float] = (60, 40), engine: str = "spimi", approximate: bool = False, few: bool = False) -> DataFrame:
        """The k best products of each query by what is given, with their record; nothing given, nothing found.

        ``postgres`` matches all lexemes, ranks by how near they stand, compares vectors, exactly unless
        ``approximate``, and cuts each side at its 1000 best before fusion. Any
        other engine is ``spimi``, the inverted indexes.
        """
        if texts is not None:
            texts = texts.withColumn("text", F.trim("text")).where("text != ''")
        if texts is not None and images is not None:
            scored = fuse(self.text_scores(texts, engine, few), self.image_scores(images, engine, approximate), *weights, truncate=DATABASE_CUT if engine == "postgres" else None)
        elif texts is not None:
            scored = self.text_scores(texts, engine, few)
        elif images is not None:
            scored = self.image_scores(images, engine, approximate)
        else:
            return self.spark.createDataFrame([], f"query_id long, rank long, doc_id long, score double, url string, {', '.join(f'{f} string' for f in FIELDS)}")
        return enriched(top_k(scored, k), self.descriptors)

    def search_text(self, text: str, k: int = 10, engine: str = "spimi") -> DataFrame:
        return self.search(query_frame(self.spark, [text]), k=k, engine=engine, few=True)

    def details(self, doc_id: int) -> DataFrame:
        return details(self.descriptors, doc_id)


def _last_build(spark: SparkSession, path: str) -> str | None:
    """The folder of the last finished build, None before there is one."""
    try:
        found = spark.read.schema("number long, place string").parquet(f"{path}/builds").orderBy(F.desc("number"), "place").first()
    except AnalysisException:  # no such folder
        return None
    return found.place if found else None


def _place(spark: SparkSession, path: str) -> str:
    """Where the next build goes: the path itself while nothing there can be read, then a new folder each time."""
    return f"{path}/build-{uuid.uuid4().hex}" if _last_build(spark, path) else path


def _publish(spark: SparkSession, path: str, place: str) -> None:
    """Notes a finished build as the last one. A note is one file, which is there whole or not at all."""
    rows = spark.createDataFrame([(time.time_ns(), place)], "number long, place string")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/builds")


def _codebook(tf: DataFrame, terms: int) -> DataFrame:
    """The ``terms`` most frequent terms, equals by the least document, then term."""
    seen = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.min("doc_id").alias("first"))
    return seen.orderBy(F.desc("cf"), "first", "term").limit(terms).select("term")


def _frequencies(rows: DataFrame, stop_words, stemmed: bool, chunked: bool, key: str) -> DataFrame:
    if chunked:
        rows = chunk_rows(rows.withColumnRenamed(key, "doc_id")).withColumnRenamed("doc_id", key)
    return term_frequencies(rows, list(stop_words), stemmed, key)


def enriched(ranked: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Ranked results with url and the nine fields; scores to 6 places. Unknown products have a null url and empty fields."""
    known = descriptors.select("doc_id", "url", unpack_record(F.col("text")).alias("f"))
    joined = ranked.join(known, "doc_id", "left")
    return joined.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "url", *(F.coalesce(F.col(f"f.{n}"), F.lit("")).alias(n) for n in FIELDS))


def formatted(results: DataFrame) -> DataFrame:
    """The service's result rows: id, name, match percentage cut to whole percents, and image link."""
    name = F.coalesce(F.nullif(F.col("product_name"), F.lit("")), F.lit("Unknown"))
    return results.select("query_id", "rank", F.col("doc_id").cast("string").alias("id"), name.alias("name"), percentage(F.col("score")).alias("match_percentage"), F.col("url").alias("image_url"))


def details(descriptors: DataFrame, doc_id: int) -> DataFrame:
    """One product as a nested record; no row for an unknown id."""
    return descriptors.where(F.col("doc_id") == doc_id).select(F.col("doc_id").cast("string").alias("id"), F.col("url").alias("image_url"), unpack_record(F.col("text")).alias("attributes"))
