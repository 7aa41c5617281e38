"""Mixing sources to target weights with DataFrame operations only.

Every row gets a hash-random key. A bucket is a fixed range of keys, so buckets
hold about equally many rows of any source, a hot source included, and no
sampling decides where a row goes. Token counts are summed per (source,
bucket), prefix sums run over buckets in two levels and then inside each
bucket, and each source is cut at its exact budget. Rows that are alike in all that
places them are counted together, so many rows of one id are one row there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, staged, whole_rows, whole_text

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 52
#: Rows alike that one step of their spreading puts up.
COPIES = 65536


def hash_key(column: Column, seed: str) -> Column:
    """A hash-random integer below 2**52."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_key(column: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """A target of words for each source.

    ``totals``: sk, source, source_size, one row a source. Sources in code-point
    order, null last, weigh ``weights`` in turn and share ``share`` of all words;
    no target is above ``max_epochs`` times its source, and what is above goes to
    the others by weight until none is. That fixed point is a water level: the
    first source, by size over weight, whose share at the level left by those
    before it fits. The table has one row a source, hence the global windows.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    order = Window.orderBy("ratio", "rank")
    t = totals.withColumn("rank", rank)
    t = t.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1))
    t = t.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("budget") - before) / rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("ratio", "rank", "level"))
    t = t.withColumn("water", F.min(fits).over(every)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return t.select("sk", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    bucket_rows: int = 256,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken; one row for each
    input row. Whole epochs of a source come first; the rest of its budget is
    taken in key order and cut inside the document that crosses it.

    Null text has size 0; null sources form one source, the last; null and
    repeated doc_ids are rows like any other; documents of size 0 take 0; an
    empty table gives an empty result; further columns are ignored.
    """
    narrow = docs.select(
        F.col("doc_id"),
        F.col("source"),
        source_key(F.col("source")).alias("sk"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        hash_key(F.col("doc_id"), seed).alias("key"),
    )
    rows = staged(narrow)
    alike = ["sk", "bucket", "key", "doc_id", "size"]
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / bucket_rows)))
    rows = rows.withColumn("bucket", F.shiftright("key", KEY_BITS - bits)).withColumn("block", F.shiftright("bucket", 10))

    by_bucket = rows.groupBy("sk", "block", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("words"))
    by_block = by_bucket.groupBy("sk", "block").agg(F.min("source").alias("source"), F.sum("words").alias("words"))
    totals = by_block.groupBy("sk").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs)

    def prefix(words: str, window) -> Column:
        return F.coalesce(F.sum(words).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = by_block.select("sk", "block", prefix("words", Window.partitionBy("sk").orderBy("block")).alias("block_start")).join(targets, "sk")
    buckets = by_bucket.select("sk", "block", "bucket", prefix("words", Window.partitionBy("sk", "block").orderBy("bucket")).alias("bucket_start"))
    starts = buckets.join(blocks, ["sk", "block"]).select("sk", "bucket", "source_size", "target", (F.col("block_start") + F.col("bucket_start")).alias("start"))
    # rows alike in id and size stand side by side: the window adds up one row of each sort, whatever their number
    sorts = rows.groupBy(*alike).agg(F.first("source").alias("source"), F.count("*").alias("n"))
    inside = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "size")
    placed = sorts.withColumn("words", F.col("n") * F.col("size")).withColumn("ahead", prefix("words", inside)).join(starts, ["sk", "bucket"])
    # and then stand one after the other, in two steps so that no array is longer than COPIES or the rows over COPIES
    placed = placed.withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    placed = placed.withColumn("place", F.explode(F.expr(f"sequence(first, least(n, first + {COPIES}L) - 1)")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    before = F.col("start") + F.col("ahead") + F.col("place") * F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents repeated by whole epochs, and one of each source cut after its last word that fits.

    All columns stay. Rows equal in doc_id, source and size share what they take.
    """
    keys = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_sk") == F.col("_source"), F.col("_size") == F.col("_words")]
    grouped = mix_sources(docs, **options).groupBy(F.col("doc_id").alias("_id"), source_key(F.col("source")).alias("_source"), F.col("size").alias("_words"))
    # written apart, so that no aggregate below the join keeps an id of many rows from being split
    plan = staged(grouped.agg(F.sum("taken").alias("_sum"), F.count("*").alias("_n")), narrow=True)
    rows = docs.select(whole_rows(docs).alias("_doc"), "doc_id", source_key(F.col("source")).alias("_sk"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("_size"))
    placed = rows.join(plan, keys[0] & keys[1] & keys[2]).withColumn("_taken", F.floor(F.col("_sum") / F.col("_n")).cast("long"))
    placed = placed.where("_taken > 0").withColumn("_full", F.expr("_taken div _size")).withColumn("_rest", F.expr("_taken % _size"))
    copies = F.concat(F.when(F.col("_full") > 0, F.array_repeat(F.col("_size"), F.col("_full").cast("int"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<bigint>")))
    placed = placed.select("_doc", "_size", F.explode(copies).alias("_take"))
    pieces = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("_take") == F.col("_size"), F.col("_doc.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("_take").cast("int")), ""))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(text.alias(name))
        elif name == "n_chars":
            out.append(F.when(F.col("_take") == F.col("_size"), F.col("_doc.n_chars")).otherwise(F.char_length(text)).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col(f"_doc.{quoted(name)}").alias(name))
    return placed.select(*out)
