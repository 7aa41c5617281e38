"""Source divergence audit: how the terms of each source differ from those of the others and of its language.

Tasks count terms of their documents with DuckDB. Counts are dealt into shards
by hash of lang and term, so a shard has all of a term; there DuckDB sums them
and keeps the terms of enough documents. A second pass over the shards takes
partial sums for every two sources and the best terms of each source, and Spark
adds the sums up and ranks.

A source without a term still gives it a share, the same for every such term. So
a pair's sum is that of two such shares over all kept terms, corrected for terms
that one side has, by how many terms have each share, and for terms that both
have. Only counts above zero are ever joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .common import shuffle_partitions, staged
from .textbytes import tidy

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Bytes of text behind a shard of counts, and kept terms in a shard of pair sums, at most on average.
SHARD_BYTES, SHARD_TERMS = 32 << 20, 1 << 13

COUNTED = "lang string, source string, term string, n bigint, docs bigint"
KEPT = "lang string, term string, n bigint, sources array<string>, counts array<bigint>"
FOUND = "lang string, source string, part string, item string, value string"

COUNT_TERMS = f"""
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
FROM (SELECT lang, source, doc, term, count(*) AS n
      FROM (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM block)
      GROUP BY ALL)
GROUP BY lang, source, term"""

SUM_TERMS = """
SELECT lang, term, sum(n)::BIGINT AS n, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts
FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM block GROUP BY ALL)
GROUP BY lang, term HAVING sum(docs) >= {least_docs}"""

#: p, of a pair q, as shares of UNIT; f = (p - q)^2 / q cut to a whole number. Products are below 2^63, sums are of 128 bits.
GROUPS = f"""
CREATE TABLE g AS SELECT source, size, kinds, lang_size, (1 + {UNIT} // (size + kinds))::BIGINT AS none FROM groups WHERE kinds > 0"""
SHARES = f"""
CREATE TABLE x AS SELECT term, source, none, (1 + {UNIT}::HUGEINT * (n + 1) // (size + kinds))::BIGINT AS p, (1 + {UNIT}::HUGEINT * (total + 1) // (lang_size + kinds))::BIGINT AS q
FROM (SELECT term, n AS total, unnest(sources) AS source, unnest(counts) AS n FROM block) JOIN g USING (source)"""
PAIR_SUMS = """
WITH h AS (SELECT source, none, p, count(*)::HUGEINT AS terms FROM x GROUP BY ALL),
parts AS (
  SELECT h.source, g.source AS item, sum(terms * ((p - g.none) * (p - g.none) // g.none - (h.none - g.none) * (h.none - g.none) // g.none)) AS value
  FROM h JOIN g ON h.source <> g.source GROUP BY ALL
  UNION ALL
  SELECT g.source, h.source AS item, sum(terms * ((g.none - p) * (g.none - p) // p - (g.none - h.none) * (g.none - h.none) // h.none)) AS value
  FROM h JOIN g ON h.source <> g.source GROUP BY ALL
  UNION ALL
  SELECT a.source, b.source AS item, sum(
    (a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.none) * (a.p - b.none) // b.none
    - (a.none - b.p) * (a.none - b.p) // b.p + (a.none - b.none) * (a.none - b.none) // b.none) AS value
  FROM x a JOIN x b ON a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT source, 'pair' AS part, item, sum(value)::VARCHAR AS value FROM parts GROUP BY source, item"""
BEST_TERMS = """
SELECT source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::VARCHAR AS value
FROM x WHERE p > q QUALIFY row_number() OVER (PARTITION BY source ORDER BY (p - q) * (p - q) // q DESC, term) <= {most}"""


def _database():
    """A DuckDB of one thread that keeps all in memory: shards are of bounded size."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _arrow(connection, sql: str) -> pa.Table:
    return connection.sql(sql).to_arrow_table()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        with _database() as db:
            db.register("block", block.append_column("doc", pa.array(range(block.num_rows), pa.int64())))
            yield from _arrow(db, COUNT_TERMS).to_batches(max_chunksize=1 << 16)


def term_counts(rows: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """lang, term, its occurrences, and its sources with their counts, of terms in at least ``least_docs`` documents of the lang.

    ``rows``: lang, source and text without nulls.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            with _database() as db:
                db.register("block", pa.Table.from_batches(held))
                yield from _arrow(db, SUM_TERMS.format(least_docs=least_docs)).to_batches(max_chunksize=1 << 13)

    return rows.mapInArrow(tidy(_count), COUNTED).repartition(shards, "lang", "term").mapInArrow(tidy(add), KEPT)


def group_sizes(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), kinds (kept terms of the lang) and lang_size of every group."""
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    size = each.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_size"))
    every = rows.select("lang", "source").distinct()
    return every.join(size, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kinds", "lang_size"])


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: what sets each source of a lang apart.

    Part ``pair`` has the divergence from each other source of the lang, part
    ``term`` the ``most_terms`` kept terms that the source has most above the
    lang. Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), a divergence is
    floor((p - q)^2 / q), for a pair summed over all V kept terms of the lang.

    Null lang, source and text are empty strings. Repeated rows are documents
    each. Groups without terms have their pairs; a lang without kept terms has
    value 0 in all; a lang of one source has no pairs. An empty table gives an
    empty result; further columns are ignored. A document is held whole by its
    task, and so are the sources of one lang, of which the result has the square.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = staged(term_counts(rows, least_docs, max(shuffle_partitions(spark), -(-size // SHARD_BYTES))))
    groups = staged(group_sizes(rows, kept), narrow=True)
    langs = groups.groupBy("lang").agg(F.ceil(F.max("kinds") / SHARD_TERMS).alias("shards"))
    dealt = kept.join(langs, "lang").withColumn("shard", F.expr("pmod(xxhash64(term), shards)")).drop("shards")
    known = groups.join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")

    def sums(key: tuple, block: pa.Table, groups: pa.Table) -> pa.Table:
        with _database() as db:
            db.register("block", block)
            db.register("groups", groups)
            db.execute(GROUPS)
            db.execute(SHARES)
            found = pa.concat_tables([_arrow(db, PAIR_SUMS), _arrow(db, BEST_TERMS.format(most=most_terms))])
        return found.add_column(0, "lang", pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    parts = staged(dealt.groupBy("lang", "shard").cogroup(known.where("kinds > 0").groupBy("lang", "shard")).applyInArrow(sums, FOUND))

    share = groups.withColumn("none", F.when(F.col("kinds") > 0, F.expr(f"1 + {UNIT} div (size + kinds)")).otherwise(F.lit(1)))
    other = share.select("lang", F.col("source").alias("item"), F.col("none").alias("q"))
    base = F.col("kinds").cast("decimal(38,0)") * F.expr("((none - q) * (none - q)) div q").cast("decimal(19,0)")
    pairs = share.join(other, "lang").where("source != item").select("lang", "source", "item", base.cast("decimal(38,0)").alias("value"))
    found = parts.withColumn("value", F.col("value").cast("decimal(38,0)"))
    pairs = pairs.unionByName(found.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")),
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= most_terms),
    ]
    return ranked[0].unionByName(ranked[1])
