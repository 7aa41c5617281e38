"""Sinks and updates of the descriptor table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(batch: DataFrame, order: str) -> DataFrame:
    """One row a doc_id: of each column the last value, by ``order``, that is not empty."""

    def last(name: str):
        filled = F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(order))
        return F.coalesce(F.max_by(F.when(filled.isNotNull(), F.col(name)), filled), F.lit("")).alias(name)

    return batch.groupBy("doc_id").agg(last("url"), last("text"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after an update by doc_id: an incoming empty url or text leaves the old one."""
    n = new.select("doc_id", F.col("url").alias("new_url"), F.col("text").alias("new_text"))

    def pick(name: str):
        return F.when(F.coalesce(F.col(f"new_{name}"), F.lit("")) != "", F.col(f"new_{name}")).otherwise(F.coalesce(name, f"new_{name}")).alias(name)

    return old.join(n, "doc_id", "full_outer").select("doc_id", pick("url"), pick("text"))


def set_histograms(table: DataFrame, histograms: DataFrame, column: str, size: int) -> DataFrame:
    """The table with the vectors of ``histograms`` (doc_id, histogram) set in ``column``; others keep theirs.

    Vectors of another size are an error; those of unknown documents have no effect.
    """
    right = F.size("histogram") == size
    checked = histograms.select("doc_id", F.when(right, F.col("histogram")).otherwise(F.raise_error(F.lit(f"a histogram must have {size} places")).cast(histograms.schema["histogram"].dataType)).alias("_new"))
    old = F.col(column) if column in table.columns else F.lit(None)
    joined = table.join(checked, "doc_id", "left").withColumn(column, F.coalesce("_new", old))
    return joined.drop("_new")


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of the schema, in place of any that is there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def dump_csv(table: DataFrame, path: str) -> None:
    """CSV with header; vectors as JSON text."""
    vectors = [f.name for f in table.schema if f.dataType.typeName() == "array"]
    table.withColumns({c: F.to_json(c) for c in vectors}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def disk_mb(spark, *paths: str) -> float:
    """Size of the files under some folders in MB, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("length")
    return round((files.agg(F.sum("length")).first()[0] or 0) / 1e6, 2)


_folders: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A fresh path that all executors reach: under spark.checkpoint.dir, or where that is unset and the
    executors are in this process, under a temporary folder that goes when the process does."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        if not _folders:
            _folders.append(tempfile.mkdtemp(prefix="vitrine-"))
            atexit.register(shutil.rmtree, _folders[0], ignore_errors=True)
        shared = f"file://{_folders[0]}"
    return f"{shared}/scratch-{uuid.uuid4().hex}"
