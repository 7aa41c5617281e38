"""Training corpus from raw documents: each stage works on all that the one before it kept.

All stages take null in any column, empty and very long texts, repeated rows and
ids, empty tables and further columns of any name, which all but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import bound_batches, discard, documents, labels, staged, whole_rows
from vitrine.llm.mixing import mixture
from vitrine.llm.neardup import keep_one
from vitrine.llm.packing import pack
from vitrine.llm.pii import sanitise
from vitrine.llm.quality import fit_quality, score_quality

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null text is scored as an empty one; without labels of both classes the score
    is their mean, or a half, and all stay.
    """
    bound_batches(spark)
    model = fit_quality(docs, labels(spark, sf_dir))
    rows = docs.select(whole_rows(docs).alias("doc"), "text")
    return score_quality(rows, model, "doc").where(F.col("score") >= QUALITY_THRESHOLD).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least doc_id, of equal ids the least text, null ids last.

    Null text equals empty text, of which one stays.
    """
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that reveal it, replaced; n_chars follows. Null text stays null, all rows stay."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, repeated and cut as the budgets ask; n_chars follows.

    Null sources are one source. Documents without words take nothing and go.
    """
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences; null text counts as empty and is its end token alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mix", mix), ("packing", packing)]

#: A fitted network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
