"""Superimposed word signatures: a few longs a document that tell most documents without all terms of a query apart.

Every lexeme sets one bit. A document whose signature lacks a bit of the query's
cannot match; the others are candidates, which are rechecked on their lexemes, so
the answers are exact and the signature's length decides only how many are
looked at in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path, write_table

WORD = 64


def bit_of(term: Column, bits: int) -> Column:
    """The bit that a lexeme sets, from 0."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % bits).cast("int")


def _words(bit: str, bits: int) -> list[Column]:
    """Aggregates of a signature's longs over rows of a bit each; fixed in size, so they are summed up before the shuffle."""
    mask = F.expr(f"shiftleft(1L, {bit} % {WORD})")
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col(bit) / WORD) == i, mask)), F.lit(0).cast("long")) for i in range(bits // WORD)]


def _set_bits(signature: Column, bits: int) -> Column:
    """The bits of a signature as an array of numbers."""
    held = F.transform(signature, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w, b) == 1), lambda b: i * WORD + b))
    return F.flatten(held)


def signatures(tf: DataFrame, bits: int = 1024) -> DataFrame:
    """doc_id, signature (``bits`` bits, a multiple of 64, as longs) and the distinct lexemes of every document with any."""
    if bits <= 0 or bits % WORD:
        raise ValueError(f"bits must be a positive multiple of {WORD}")
    rows = tf.where("term is not null").select("doc_id", "term", bit_of(F.col("term"), bits).alias("bit"))
    return rows.groupBy("doc_id").agg(F.array(*_words("bit", bits)).alias("signature"), F.collect_set("term").alias("lexemes"))


def wanted(asked: DataFrame, bits: int = 1024) -> DataFrame:
    """query_id, its signature and its distinct lexemes; a query without lexemes is not there."""
    return signatures(asked.select(F.col("query_id").alias("doc_id"), "term"), bits).withColumnRenamed("doc_id", "query_id")


def candidates(signed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and doc_id where the document's signature has all bits of the query's.

    ``signed`` and ``queries`` are written tables of ``signatures`` and ``wanted``. A
    query meets only the documents that hold its rarest bit, by an equal join on
    that bit: the counts of bits are one row a bit, and documents put up none but
    the bits that are some query's rarest, a mask as long as a signature.
    """
    n = queries.select(F.size("signature").alias("n")).first()
    if n is None:
        return signed.select(F.lit(0).cast("long").alias("query_id"), "doc_id").limit(0)
    bits = n.n * WORD
    counts = signed.select(F.explode(_set_bits(F.col("signature"), bits)).alias("bit")).groupBy("bit").agg(F.count("*").alias("docs"))
    places = queries.select("query_id", F.col("signature").alias("all"), F.explode(_set_bits(F.col("signature"), bits)).alias("bit"))
    # a bit that no document sets stays, with none, and finds nothing
    rare = places.join(counts, "bit", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "bit")).alias("r"), F.first("all").alias("all"))
    path = scratch_path(signed.sparkSession)
    write_table(rare.select("query_id", "all", F.col("r.bit").alias("bit")), path)
    rare = signed.sparkSession.read.parquet(path)
    mask = F.array(*(F.lit(w).cast("long") for w in rare.agg(F.array(*_words("bit", bits))).first()[0]))
    asked_bits = _set_bits(F.zip_with("signature", mask, lambda a, b: a.bitwiseAND(b)), bits)
    held = signed.select("doc_id", "signature", F.explode(asked_bits).alias("bit")).join(rare, "bit")
    missing = F.exists(F.zip_with("signature", "all", lambda a, b: a.bitwiseAND(b) != b), lambda lacks: lacks)
    return held.where(~missing).select("query_id", "doc_id")


def recheck(found: DataFrame, signed: DataFrame, queries: DataFrame) -> DataFrame:
    """The candidates whose lexemes hold all of the query's."""
    terms = queries.select("query_id", F.col("lexemes").alias("terms"))
    held = found.join(signed.select("doc_id", "lexemes"), "doc_id").join(terms, "query_id")
    return held.where(F.size(F.array_except("terms", "lexemes")) == 0).select("query_id", "doc_id")


def match_signed(signed: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id and doc_id of the documents with all lexemes of a query, as ``fulltext.match_all`` gives them.

    ``signed``: a written table of ``signatures``; ``asked``: query_id and term,
    repeats allowed. Queries without lexemes match nothing.
    """
    first = signed.select(F.size("signature").alias("n")).first()
    spark, path = signed.sparkSession, scratch_path(signed.sparkSession)
    write_table(wanted(asked, first.n * WORD if first else WORD), path)
    queries = spark.read.parquet(path)
    return recheck(candidates(signed, queries), signed, queries)
