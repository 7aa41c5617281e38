"""``python -m vitrine build`` and ``python -m vitrine search``: an engine on disk from a corpus file, and one query to it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.vectors import matrix
from .plans.engine import Engine, formatted
from .sources.tables import read_stop_words, read_text_corpus


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list:
    parser = argparse.ArgumentParser(prog="vitrine", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("corpus", help="CSV of id and texto")
    build.add_argument("path", help="folder of the engine")
    build.add_argument("--dataset-size", type=int, help="rows of least id")
    build.add_argument("--vectors", help="Parquet of doc_id and embedding")
    build.add_argument("--centres", help="Parquet of codeword_id and centre")
    build.add_argument("--stop-words", help="file of one word a line")
    search = commands.add_parser("search")
    search.add_argument("path", help="folder of the engine")
    search.add_argument("--text", help="words to find")
    search.add_argument("--vector", help="numbers of a query vector, by commas")
    search.add_argument("--engine", default="spimi")
    search.add_argument("-k", type=int, default=10)
    given = parser.parse_args(arguments)
    if given.command == "search" and not (given.text or given.vector):
        parser.error("a search needs --text or --vector")
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "build":
        corpus = read_text_corpus(spark, given.corpus, given.dataset_size).select("doc_id", F.lit("").alias("url"), "text")
        vectors = spark.read.parquet(given.vectors) if given.vectors else None
        places = spark.read.parquet(given.centres).orderBy("codeword_id").collect() if given.centres else []
        words = tuple(read_stop_words(spark, given.stop_words)) if given.stop_words else ()
        Engine.build(spark, corpus, vectors, matrix([r.centre for r in places]) if places else None, stop_words=words, path=given.path)
        return []
    engine = Engine.read(spark, given.path)
    texts = spark.createDataFrame([(0, given.text)], "query_id long, text string") if given.text else None
    images = spark.createDataFrame([(0, [float(x) for x in given.vector.split(",")])], "query_id long, vector array<double>") if given.vector else None
    found = formatted(engine.search(texts, images, k=given.k, engine=given.engine, few=True)).orderBy("rank").collect()
    for r in found:
        print(r.rank, r.id, r.match_percentage, r.name, sep="\t")
    return found


if __name__ == "__main__":
    main()
