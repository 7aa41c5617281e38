"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch sent to a Python worker, whatever the rows' sizes.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Workers get batches by bytes, so their memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a master without executors of its own may fall back to a temporary folder, which goes when the driver does.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    global _local_dir
    if _local_dir is None:
        folder = tempfile.mkdtemp(prefix="vitrine-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dir = "file://" + folder
    return _local_dir


_local_dir: str | None = None


#: Shuffle partitions are counted for whole texts; a table of a few numbers a row is written by a part of as many tasks.
NARROW = 8


def staged(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs a re-read and
    not the whole lineage, and rows computed once stay the same rows. ``narrow``
    is for rows of a few numbers: fewer tasks, and so fewer files, are enough.
    """
    spark = df.sparkSession
    bound_batches(spark)
    if narrow:
        df = df.coalesce(max(1, shuffle_partitions(spark) // NARROW))
    path = f"{shared_dir(spark)}/vitrine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing to come reads; other tables are left alone."""
    for table in tables:
        path = getattr(table, "__dict__", {}).pop("staged_path", None)
        if path is not None:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def quoted(name: str) -> str:
    """A column's name as it must be written for names with dots or backticks to be found."""
    return f"`{name.replace('`', '``')}`"


def whole_rows(df: DataFrame):
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col(quoted(n)) for n in df.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    bound_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))
