"""Sources: corpora in CSV, images, stop words, dumps and query sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_id, is_defined, pack_record, repair_line

#: Columns of the raw product file, in order (fixed values).
PRODUCT = ("id", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "productDisplayName")


def read_text_corpus(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """doc_id and text from a CSV of id and texto; the ``size`` rows of least id."""
    rows = spark.read.schema("id long, texto string").option("header", True).option("escape", '"').csv(path)
    rows = rows.select(F.col("id").alias("doc_id"), F.coalesce("texto", F.lit("")).alias("text"))
    return rows if size is None else rows.orderBy("doc_id").limit(size)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and packed record of a raw product file; commas in the last field do not need quotes."""
    lines = spark.read.text(path).where(~F.col("value").startswith("id,"))
    parts = lines.select(repair_line(F.col("value")).alias("p"))
    fields = [F.get("p", i) for i in range(len(PRODUCT))]
    return parts.select(fields[0].try_cast("long").alias("doc_id"), pack_record([F.nullif(f, F.lit("")) for f in fields[1:]]).alias("text")).where("doc_id is not null")


def read_image_links(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, filename and url; rows without a link go."""
    rows = spark.read.schema("filename string, link string").option("header", True).csv(path)
    return rows.where(is_defined(F.col("link"))).select(file_id(F.col("filename")).cast("long").alias("doc_id"), "filename", F.col("link").alias("url"))


def read_images(spark: SparkSession, folder: str, links: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """doc_id, path and content of the .jpg files of a folder, only those in ``links`` if given; ``size`` counts after that."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    images = files.select(file_id(F.col("path")).cast("long").alias("doc_id"), "path", "content")
    if links is not None:
        images = images.join(links.select("doc_id", "url"), "doc_id")
    return images if size is None else images.orderBy("doc_id").limit(size)


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Distinct words of a file of one word a line; no such file, no words."""
    try:
        rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w != ''").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r.w for r in rows)


def read_descriptors(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The descriptor dump; vectors are written as text in it."""
    rows = spark.read.schema("doc_id long, url string, texto string, image_histogram string, text_histogram string").option("header", True).option("escape", '"').csv(path)
    for name in ("image_histogram", "text_histogram"):
        rows = rows.withColumn(name, F.from_json(name, "array<float>"))
    return rows.select(*columns) if columns else rows


def vector_size(df: DataFrame, column: str) -> int | None:
    """Dimension of the vectors, from one row."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    return row.n if row else None


def has_rows(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def query_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """query_id, from 0, and text."""
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def existing(rows: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key the other table has."""
    return rows.join(known.select(key).distinct(), key, "left_semi")
