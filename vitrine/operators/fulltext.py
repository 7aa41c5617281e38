"""Boolean full-text search: documents with every term of the query, ranked by nearness of the terms or by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_terms
from ..functions.text import tokens, without
from ..sources.sinks import scratch_path, write_table
from .index import Index, score

#: Weight of a lexeme without a label, sum of 1/n^2, and the words beyond which two lexemes are not near (fixed values).
PLAIN_WEIGHT, ALL_SQUARES, NEAR = 0.1, 1.64493406685, 100


def lexemes(tf: DataFrame) -> DataFrame:
    """doc_id and its sorted distinct terms."""
    return tf.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("lexemes"))


def match_all(tf: DataFrame, query_tf: DataFrame) -> DataFrame:
    """query_id and doc_id where the document has all terms of the query; a query without terms matches nothing."""
    asked = query_tf.select("query_id", "term").distinct()
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    have = tf.select("doc_id", "term").join(asked, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("have"))
    return have.join(need, "query_id").where("have = need").select("query_id", "doc_id")


def search_all(index: Index, query_tf: DataFrame) -> DataFrame:
    """query_id, doc_id and score of the matches. The rank is a surrogate for a database's proximity rank;
    a term that is in every document matches and weighs nothing."""
    matched = match_all(index.postings, query_tf)
    return matched.join(score(index, query_tf), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def positions(docs: DataFrame, stop_words: list[str] = [], stemmed: bool = False, key: str = "doc_id") -> DataFrame:  # noqa: B006
    """Positional postings: key, term and the places, from 1, of its tokens in order. Stop words leave gaps; stems are
    looked up by distinct term. Null and empty texts have none; repeated rows of a key are one document.

    Texts are dealt out whole by key, which is less to move than their tokens, and a batch of them is sorted by word where it is."""
    dealt = docs.select(F.col(key).alias("doc_id"), "text").repartition("doc_id").sortWithinPartitions("doc_id")
    kind = docs.schema[key].dataType.simpleString()
    found = dealt.select("doc_id", tokens(F.col("text")).alias("words")).mapInArrow(partial(_places, stop_words=stop_words), f"doc_id {kind}, term string, positions array<int>")
    if stemmed:
        found = found.join(stem_terms(found), "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found.select(F.col("doc_id").alias(key), "term", "positions")


def _places(batches: Iterator[pa.RecordBatch], stop_words: list[str]) -> Iterator[pa.RecordBatch]:
    """doc_id, term and sorted places of rows (doc_id, words) in order of doc_id; a document's last row here may not be its last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        last = ids[batch.num_rows - 1]
        start = batch.num_rows - 1
        while start > 0 and ids[start - 1] == last:
            start -= 1
        if start or (held and held[-1].column(0)[0] != last):
            yield from _sorted_places([*held, batch.slice(0, start)], stop_words)
            held = []
        held.append(batch.slice(start))
    yield from _sorted_places(held, stop_words)


def _sorted_places(batches: list[pa.RecordBatch], stop_words: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if table is None or not table.num_rows:
        return
    ids, lists = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
    document = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()[row]
    if stop_words:
        stays = ~np.isin(code, np.flatnonzero(pc.is_in(coded.dictionary, pa.array(stop_words, coded.dictionary.type)).to_numpy(zero_copy_only=False)))
        code, row, place, document = code[stays], row[stays], place[stays], document[stays]
    if not len(code):
        return
    order = np.lexsort((place, code, document))
    code, row, place, document = code[order], row[order], place[order], document[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (document[1:] != document[:-1])])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), coded.dictionary.take(pa.array(code[first])), positions], ["doc_id", "term", "positions"])


def query_lexemes(queries: DataFrame, stop_words: list[str] = [], stemmed: bool = False) -> DataFrame:  # noqa: B006
    """query_id and its distinct terms, made as those of documents are."""
    words = queries.select("query_id", F.explode(F.array_distinct(without(tokens(F.col("text")), stop_words))).alias("term"))
    if stemmed:
        words = words.join(stem_terms(words), "term").select("query_id", F.col("stem").alias("term"))
    return words.distinct()


def nearness(distance: Column) -> Column:
    """What two unlabelled lexemes at a distance add to a rank, from 0 to 1: about a tenth side by side, next to nothing beyond ten words."""
    return PLAIN_WEIGHT / F.sqrt(1.005 + 0.05 * F.exp(distance / 1.5 - 2))


def _held(postings: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """query_id, doc_id, need and held (terms with positions) of the documents that have all terms of a query.

    A query's rarest term finds its documents, and the other terms are looked up
    in these alone, so that frequent terms of long queries meet few documents. What
    is asked is written first: the planner sees how large it is, and sends it to
    the postings only if it is small.
    """

    def kept(name: str, table: DataFrame) -> DataFrame:
        write_table(table, f"{path}/{name}")
        return table.sparkSession.read.parquet(f"{path}/{name}")

    asked = kept("asked", asked)
    held = postings.join(kept("terms", asked.select("term").distinct()), "term")
    counts = kept("counts", held.groupBy("term").agg(F.count("*").alias("df")))
    whole = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    rare = asked.join(counts, "term").groupBy("query_id").agg(F.count("*").alias("known"), F.min(F.struct("df", "term")).alias("rare")).join(whole, "query_id").where("known = need")
    rare = kept("rare", rare.select("query_id", "need", F.col("rare.term").alias("term")))
    candidates = postings.select("term", "doc_id").join(rare, "term").drop("term")
    hits = candidates.join(asked, "query_id").join(held, ["doc_id", "term"])
    return kept("held", hits.groupBy("query_id", "doc_id", "need").agg(F.collect_list(F.struct("term", "positions")).alias("held")).where(F.size("held") == F.col("need")))


def search_near(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id and score of the documents that have all lexemes of a query, higher the nearer they stand.

    ``postings`` comes from ``positions``, best as a written table, ``asked`` from ``query_lexemes``. Every
    two places of different lexemes that are at most NEAR words apart speak for the
    document independently: 1 less the product of 1 - nearness. A query of one
    lexeme ranks by its occurrences, the n-th of which adds 1/n^2. This is a
    database's rank for unlabelled lexemes, without its limits on places.

    Places meet by query, document and stretch of NEAR words, so a long document
    spreads, and no two places further apart than two stretches are compared.
    """
    matched = _held(postings, asked, scratch_path(postings.sparkSession))
    squares = F.aggregate(F.sequence(F.lit(1), F.size(F.col("held")[0]["positions"])), F.lit(0.0), lambda s, n: s + 1.0 / (n * n))
    alone = F.when(F.col("need") == 1, squares * PLAIN_WEIGHT / ALL_SQUARES).otherwise(F.lit(0.0))
    places = matched.where("need > 1").select("query_id", "doc_id", F.explode("held").alias("h")).select("query_id", "doc_id", "h.term", F.explode("h.positions").alias("pos"))
    stretch = F.floor(F.col("pos") / NEAR)
    left = places.withColumn("stretch", stretch)
    right = places.select("query_id", "doc_id", F.col("term").alias("other"), F.col("pos").alias("place"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    distance = F.col("place") - F.col("pos")
    pairs = left.join(right, ["query_id", "doc_id", "stretch"]).where((F.col("term") != F.col("other")) & distance.between(1, NEAR))
    near = pairs.groupBy("query_id", "doc_id").agg((1 - F.exp(F.sum(F.log(1 - nearness(distance))))).alias("score"))
    return matched.select("query_id", "doc_id", alone.alias("score")).unionByName(near).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
