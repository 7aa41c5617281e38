"""Top-k, pages and fusion of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More ranks than any list has.
EVERY = 1 << 30


def top_k(scored: DataFrame, k: int, by: str | None = "query_id", score: str = "score", key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """The k best rows, of each query if ``by`` is given, with ``rank`` from 1; equal scores by lesser key.

    ``digits`` rounds before ranking, which makes ranks independent of the order
    of summation. A filter on the rank lets Spark keep only k rows of each
    query and task before the shuffle.
    """
    if digits is not None:
        scored = scored.withColumn(score, F.round(score, digits))
    order = [F.col(score).desc(), F.col(key).asc()]
    if by is None:
        scored = scored.orderBy(*order).limit(k)
        return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number``, from 0, of each ranked list."""
    return ranked.where((F.col("rank") > number * size) & (F.col("rank") <= (number + 1) * size))


def weight(value: float) -> float:
    """A weight as a share: above 1 it is a percentage."""
    return value / 100 if value > 1 else value


def fuse(text: DataFrame, image: DataFrame, text_weight: float, image_weight: float, truncate: int | None = None) -> DataFrame:
    """Weighted sum of two score lists (query_id, doc_id, score); a missing side counts 0.

    ``truncate`` first cuts each side to its best rows. Weights are as given to
    ``weight`` and need not sum to 1.
    """
    sides = []
    for scored, share in ((text, weight(text_weight)), (image, weight(image_weight))):
        scored = scored.select("query_id", "doc_id", "score")
        if truncate is not None:
            scored = top_k(scored, truncate).drop("rank")
        sides.append(scored.withColumn("score", F.col("score") * share))
    return sides[0].unionByName(sides[1]).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; all 1 where they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def percentage(score: Column) -> Column:
    return F.concat((score * 100).cast("int").cast("string"), F.lit("%"))
