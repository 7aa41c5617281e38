"""Queries of sources, sinks, chunks, stems and patches: each writes what it reads, from whole tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .functions.chunk import SIZE
from .functions.stem import stem_terms
from .functions.vectors import patches
from .operators import bucketed, index, knn, ranking
from .queries import CODEBOOK, ORACLES, QUERIES, SQL_KNN, SQL_LISTS, SQL_RECORD, TF, _records, benchmark, centres, docs, query, query_tf, sql_scores, sql_top, table, text_index, vector_queries, vectors
from .sources import sinks, tables
from .streaming import incremental, upkeep


@query(f"""SELECT p_partkey AS doc_id, {SQL_RECORD} || ', "quoted"' AS text FROM part""")
def csv_corpus(spark, sf_dir):
    path = sinks.scratch_path(spark)
    rows = _records(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("text", F.lit(', "quoted"')).alias("texto"))
    sinks.dump_csv(rows, path)
    return tables.read_text_corpus(spark, path)


@query(f"SELECT p_partkey AS doc_id, {SQL_RECORD} AS text FROM part ORDER BY p_partkey LIMIT 100")
def csv_corpus_first(spark, sf_dir):
    """The first hundred, by id."""
    path = sinks.scratch_path(spark)
    sinks.dump_csv(_records(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("texto")), path)
    return tables.read_text_corpus(spark, path, 100)


@query("SELECT p_partkey AS doc_id, p_brand || '|' || p_type || '|' || p_size || '|a|nan|c|2011.0|Casual|' || p_name || ', two, three' AS text FROM part")
def product_file(spark, sf_dir):
    """Raw lines with commas in the last field and an empty one."""
    path = sinks.scratch_path(spark)
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", "p_type", F.col("p_size").cast("string"), F.lit("a,,c,2011.0,Casual"), F.concat("p_name", F.lit(", two, three")))
    head = spark.createDataFrame([(",".join(tables.PRODUCT),)], "value string")
    head.unionByName(table(spark, sf_dir, "part").select(line.alias("value"))).write.text(path)
    return tables.read_products(spark, path)


@query("SELECT page_id AS doc_id, page_id || '.jpg' AS filename, url FROM pages WHERE page_id % 5 <> 0")
def image_links(spark, sf_dir):
    path = sinks.scratch_path(spark)
    link = F.when(F.col("page_id") % 5 == 0, "undefined").otherwise(F.col("url"))
    sinks.dump_csv(table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("filename"), link.alias("link")), path)
    return tables.read_image_links(spark, path)


@query("SELECT page_id AS doc_id, (strlen(url) + 1)::BIGINT AS size FROM pages WHERE page_id % 5 <> 0")
def image_files(spark, sf_dir):
    """Files of the ids that have a link, other folders' and types' left out; each holds a line with its url."""
    path = sinks.scratch_path(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages.select("url", F.concat(F.lit("id"), F.col("page_id").cast("string")).alias("part")).write.partitionBy("part").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = files.select(F.regexp_extract("path", "part=id([0-9]+)", 1).cast("long").alias("doc_id"), "content")
    links = pages.where("page_id % 5 <> 0").select(F.col("page_id").alias("doc_id"))
    return tables.existing(known, links).select("doc_id", F.octet_length("content").cast("long").alias("size"))


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT lang AS w FROM documents UNION ALL SELECT source FROM documents)")
def stop_word_file(spark, sf_dir):
    """Words that come several times, in capitals and with blanks around them."""
    path = sinks.scratch_path(spark)
    d = table(spark, sf_dir, "documents")
    d.select(F.concat(F.lit("  "), F.upper("lang")).alias("value")).union(d.select(F.concat("source", F.lit(" ")))).write.text(path)
    return spark.createDataFrame([(w,) for w in tables.read_stop_words(spark, path)], "word string")


@query("SELECT vec_id AS doc_id, 'u' || vec_id AS url, label::VARCHAR AS texto, len(embedding)::BIGINT AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def dump_and_load(spark, sf_dir):
    """The descriptor dump written and loaded, vectors as text in it."""
    path = sinks.scratch_path(spark)
    v = vectors(spark, sf_dir).select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.col("label").cast("string").alias("texto"), F.col("embedding").alias("image_histogram"), F.array(F.lit(1.0)).alias("text_histogram"))
    sinks.dump_csv(v, path)
    total = F.aggregate("image_histogram", F.lit(0.0), lambda s, x: s + x)
    return tables.read_descriptors(spark, path).select("doc_id", "url", "texto", F.size("image_histogram").cast("long").alias("size"), F.round(total, 6).alias("total"))


@query("SELECT vec_id AS doc_id, 'u' || vec_id AS url FROM embeddings")
def load_columns(spark, sf_dir):
    """Some columns of a dump."""
    path = sinks.scratch_path(spark)
    v = vectors(spark, sf_dir).select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("").alias("texto"), F.col("embedding").alias("image_histogram"), F.col("embedding").alias("text_histogram"))
    sinks.dump_csv(v, path)
    return tables.read_descriptors(spark, path, ["doc_id", "url"])


@query("SELECT len(embedding)::BIGINT AS size, true AS filled, false AS known FROM embeddings WHERE embedding IS NOT NULL LIMIT 1")
def vector_dimension(spark, sf_dir):
    v = vectors(spark, sf_dir)
    v.createOrReplaceTempView("vitrine_vectors")
    found = [(tables.vector_size(v, "embedding"), tables.has_rows(spark, "vitrine_vectors"), tables.has_rows(spark, "vitrine_no_such_table"))]
    spark.catalog.dropTempView("vitrine_vectors")
    return spark.createDataFrame(found, "size long, filled boolean, known boolean")


@query("SELECT doc_id, lang AS url, source AS text FROM documents")
def replaced_table(spark, sf_dir):
    """A table of a declared schema, made, and made again with other rows."""
    path = sinks.scratch_path(spark)
    d = table(spark, sf_dir, "documents")
    sinks.create_table(spark, path, "doc_id long, url string, text string")
    sinks.write_table(d.selectExpr("doc_id", "source AS url", "lang AS text"), path)
    sinks.create_table(spark, path, "doc_id long, url string, text string")
    sinks.write_table(d.selectExpr("doc_id", "lang AS url", "source AS text"), path)
    return spark.read.parquet(path)


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark") + sql_top("s", 50))
def index_from_files(spark, sf_dir):
    """The index written, and read from its files alone."""
    path = sinks.scratch_path(spark)
    text_index(spark, sf_dir, path)
    return ranking.top_k(index.score(index.Index.read(spark, path), query_tf(benchmark(spark, sf_dir))), 50, digits=6)


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark") + f", r AS ({sql_top('s', 50)}) SELECT r.*, d.source AS url FROM r JOIN documents d USING (doc_id)")
def bucketed_search(spark, sf_dir):
    """Postings and records in buckets: neither moves in the search or in the lookup of what it found."""
    path, name = sinks.scratch_path(spark), f"vitrine_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = bucketed.write_index_bucketed(text_index(spark, sf_dir), name, f"{path}/text", buckets)
    records = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS url")
    records = bucketed.write_bucketed(records, f"{name}_records", f"{path}/records", "doc_id", buckets)
    return ranking.top_k(index.score(built, query_tf(benchmark(spark, sf_dir))), 50, digits=6).join(records, "doc_id")


@query("SELECT round(count(*) * 33 / 1e6, 2) AS mb FROM documents")
def disk_use(spark, sf_dir):
    """A line of 32 characters for each document."""
    path = sinks.scratch_path(spark)
    table(spark, sf_dir, "documents").select(F.md5("text")).write.text(path)
    return spark.createDataFrame([(sinks.disk_mb(spark, path),)], "mb double")


@query(f"WITH {TF} SELECT term, doc_id, tf FROM tf")
def stream_frequencies(spark, sf_dir):
    """Frequencies kept up from a stream of the documents."""
    path, rows = sinks.scratch_path(spark), docs(spark, sf_dir)
    rows.write.parquet(f"{path}/arrivals")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/arrivals")
    incremental.maintain(stream, f"{path}/tf", f"{path}/checkpoint").awaitTermination()
    return incremental.frequencies(spark, f"{path}/tf").select("term", "doc_id", "tf")


SQL_KEPT = f"""now AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'changed ' || lang || ' ' || source ELSE coalesce(text, '') END AS text FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
  UNION ALL SELECT 1000000000 + doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
{TF.replace("FROM documents", "FROM now")}"""


def _kept_up(spark, sf_dir):
    """All documents; then those of good quality with another text, the toxic ones with none, which leaves theirs, and again under new ids."""
    path = sinks.scratch_path(spark)
    store = upkeep.Store.create(spark, path)
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("url"), "text", "lang", "source")
    labelled = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good, toxic = d.join(labelled.where("quality = 1"), "doc_id", "left_semi"), d.join(labelled.where("toxic = 1"), "doc_id", "left_semi")
    batches = [d, good.withColumn("text", F.concat_ws(" ", F.lit("changed"), "lang", "source")), toxic.withColumn("text", F.lit("")).unionByName(toxic.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))]
    for number, batch in enumerate(batches):
        store.apply(batch.select("doc_id", "url", "text", F.lit(number).alias("order")), number)
        if number == 1:
            store.compact(1)
    return store


@query(f"WITH {SQL_KEPT} SELECT term, doc_id, tf FROM tf")
def upkeep_frequencies(spark, sf_dir):
    """Frequencies after documents came, changed and came empty."""
    return _kept_up(spark, sf_dir).frequencies()


@query(f"WITH {SQL_KEPT} SELECT term, df, round(ln((SELECT count(*) FROM now)::DOUBLE / df), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)")
def upkeep_document_frequencies(spark, sf_dir):
    store = _kept_up(spark, sf_dir)
    return store.document_frequencies().withColumn("idf", F.round(F.log(F.lit(float(store.size())) / F.col("df")), 6))


ORACLES["chunk_text"] = rf"""WITH RECURSIVE p AS (SELECT doc_id, text, CASE WHEN length(text) <= {SIZE} THEN [text] ELSE
  flatten(list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda a: NOT regexp_full_match(a, '\s*')), lambda a: CASE WHEN length(a) <= {SIZE} THEN [a] ELSE
  flatten(list_transform(list_filter(string_split(a, chr(10)), lambda b: NOT regexp_full_match(b, '\s*')), lambda b: CASE WHEN length(b) <= {SIZE} THEN [b] ELSE
  flatten(list_transform(list_filter(string_split(b, ' '), lambda c: NOT regexp_full_match(c, '\s*')), lambda c: list_transform(range(0, length(c), {SIZE}), lambda i: substr(c, i + 1, {SIZE})))) END)) END)) END AS units
  FROM documents WHERE NOT regexp_full_match(coalesce(text, ''), '\s*')),
e AS (SELECT doc_id, units, len(units) AS n, list_prepend(0, list_transform(range(1, len(units) + 1), lambda i: list_sum(list_transform(units[1:i], lambda x: length(x) + 1)))) AS ends FROM p),
w AS (SELECT doc_id, 0 AS chunk, 0::BIGINT AS low, greatest(len(list_filter(ends, lambda x: x <= {SIZE} + 1)) - 1, 1) AS i FROM e
  UNION ALL SELECT w.doc_id, chunk + 1, greatest(low, i - 1), greatest(len(list_filter(ends, lambda x: x <= ends[greatest(low, i - 1) + 1] + {SIZE} + 1)) - 1, i + 1)
  FROM w JOIN e ON e.doc_id = w.doc_id WHERE i < n)
SELECT w.doc_id, chunk, array_to_string(units[low + 1:least(i, n)], ' ') AS text FROM w JOIN e ON e.doc_id = w.doc_id"""

#: Words of the published sample of the English stemmer, and exceptions it lists, with their stems (fixed values).
STEMS = (
    "consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, "
    "consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, "
    "consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson, "
    "consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, "
    "conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, "
    "constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, "
    "kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, "
    "knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, "
    "knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot, skis ski, skies sky, dying die, lying lie, tying tie, "
    "idly idl, gently gentl, ugly ugli, early earli, only onli, singly singl, news news, howe howe, atlas atlas, cosmos cosmos, bias bias, andes andes"
)


@query("SELECT split_part(p, ' ', 1) AS term, split_part(p, ' ', 2) AS stem FROM (SELECT unnest(string_split('" + STEMS + "', ', ')) AS p)")
def stem_sample(spark, sf_dir):
    """The stemmer over its published sample."""
    return stem_terms(spark.createDataFrame([(p.split()[0],) for p in STEMS.split(", ")], "term string"))


@query(
    """SELECT vec_id, r * 3 + c AS patch, list_sum(list_transform(range(9), lambda k: CASE WHEN r * 3 + k // 3 < 8 AND c * 3 + k % 3 < 8
THEN floor(embedding[(r * 3 + k // 3) * 8 + c * 3 + k % 3 + 1]::DOUBLE * 1000) ELSE 0 END))::BIGINT AS total
FROM embeddings, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(3)) AS c)"""
)
def matrix_patches(spark, sf_dir):
    """Vectors as 8 x 8 images, cut into patches of 3 x 3, the last ones zero-padded."""

    def run(frames):
        for frame in frames:
            rows = []
            for vec_id, values in zip(frame.doc_id, frame.embedding, strict=True):
                image = np.floor(np.asarray(values, np.float64).reshape(8, 8) * 1000)
                rows += [(vec_id, i, int(tile.sum())) for i, tile in enumerate(patches(image, (3, 3)))]
            yield pd.DataFrame(rows, columns=["vec_id", "patch", "total"])

    return vectors(spark, sf_dir).select("doc_id", "embedding").mapInPandas(run, "vec_id long, patch long, total long")


def measured_recall(spark, sf_dir, found, k: int = 10):
    """The share of the exact answers to all queries that an approximate search found, and whether it is nine tenths."""
    asked = vector_queries(spark, sf_dir, "doc_id % 20 = 0")
    exact = knn.knn_exact(vectors(spark, sf_dir), asked, k).select("query_id", "doc_id")
    hits = exact.join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    recall = F.round(F.count("hit") / F.count("*"), 6)
    return hits.agg(recall.alias("recall"), (recall >= 0.9).alias("reached"))


@query()
def lsh_recall(spark, sf_dir):
    """Recall of search by signatures."""
    return measured_recall(spark, sf_dir, QUERIES["lsh_knn"](spark, sf_dir))


@query(
    f"""WITH {SQL_LISTS}, l AS ({sql_top('s', 10)}), x AS ({SQL_KNN} q.vec_id % 20 = 0), e AS ({sql_top('x', 10)})
SELECT round(count(l.doc_id) / count(*), 6) AS recall, count(l.doc_id) / count(*) >= 0.9 AS reached FROM e LEFT JOIN l ON l.query_id = e.query_id AND l.doc_id = e.doc_id"""
)
def ivf_recall(spark, sf_dir):
    """The same of search by lists, which SQL can do as well."""
    return measured_recall(spark, sf_dir, QUERIES["ivf_knn"](spark, sf_dir))


@query()
def graph_recall(spark, sf_dir):
    """The same of search by graphs, with the share of all vectors that a query is compared with on average."""
    found = QUERIES["graph_knn"](spark, sf_dir)
    work = found.groupBy("query_id").agg(F.max("compared").alias("n")).agg(F.avg("n").alias("n"))
    n = vectors(spark, sf_dir).agg(F.count("*").alias("every"))
    share = work.first().n / n.first().every
    return measured_recall(spark, sf_dir, found).withColumn("compared_share", F.round(F.lit(share), 6))


def inertia(found, centres: np.ndarray) -> float:
    """Sum of squared distances of all vectors to their nearest centre."""

    def run(frames):
        for frame in frames:
            if len(frame):
                x = np.stack(frame.embedding.to_numpy()).astype(np.float64)
                far = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
                yield pd.DataFrame({"part": [float(far.min(axis=1).sum())]})

    return found.select("embedding").mapInPandas(run, "part double").agg(F.sum("part")).first()[0]


@query()
def kmeans_inertia(spark, sf_dir):
    """Inertia of the k-means codebook over all vectors, and of as many vectors as centres."""
    found = vectors(spark, sf_dir)
    made, plain = inertia(found, index.kmeans_codebook(found, CODEBOOK)), inertia(found, centres(spark, sf_dir, CODEBOOK))
    return spark.createDataFrame([(round(made, 6), round(plain, 6), made < 0.95 * plain)], "inertia double, of_vectors double, closer boolean")


@query()
def minibatch_inertia(spark, sf_dir):
    """The same of centres of batches in order of arrival."""
    found = vectors(spark, sf_dir)
    made = inertia(found, index.minibatch_codebook(found, sinks.scratch_path(spark), CODEBOOK, batch=256).centres)
    plain = inertia(found, centres(spark, sf_dir, CODEBOOK))
    return spark.createDataFrame([(round(made, 6), round(plain, 6), made < 0.95 * plain)], "inertia double, of_vectors double, closer boolean")
