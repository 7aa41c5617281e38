"""Registered queries and their DuckDB counterparts.

The driver's tables stand in for the product corpus: ``documents`` for texts,
``benchmark`` for text queries, ``embeddings`` for image vectors and their
relevance labels, ``part`` for product records.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.chunk import chunk_rows
from .functions.stem import stem_terms
from .functions.vectors import matrix, nearest_codeword
from .operators import evaluate, fulltext, graph, index, knn, ranking, signatures, threshold
from .plans import engine
from .sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A short list for the stop-word query; the engine's own list is a parameter.
STOP_WORDS = ["the", "of", "and", "a", "is", "le", "la", "de", "der", "die", "el", "que"]
WORDS = ["the of", "and thing", "is the er", "zzz the", ""]
CODEBOOK, LISTS = 16, 10


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark, sf_dir, where: str = "true"):
    return table(spark, sf_dir, "benchmark").where(where).selectExpr("item_id AS query_id", "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding", "label")


def vector_queries(spark, sf_dir, where: str):
    return vectors(spark, sf_dir).where(where).selectExpr("doc_id AS query_id", "embedding AS vector")


def centres(spark, sf_dir, n: int) -> np.ndarray:
    rows = vectors(spark, sf_dir).where(F.col("doc_id") < n).orderBy("doc_id").collect()
    return matrix([r.embedding for r in rows])


def kept_frequencies(spark, sf_dir) -> DataFrame:
    return index.kept(index.term_frequencies(docs(spark, sf_dir)))


def text_index(spark, sf_dir, path: str | None = None) -> index.Index:
    return index.write_index(kept_frequencies(spark, sf_dir), docs(spark, sf_dir).count(), path or sinks.scratch_path(spark))


def query_tf(queries: DataFrame) -> DataFrame:
    return index.term_frequencies(queries, key="query_id")


def long_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# DuckDB fragments


def sql_tokens(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


TF = f"""tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"""
IDF = """n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, count(*) AS df, ln((SELECT n FROM n)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id)"""


def sql_scores(queries: str) -> str:
    """CTEs up to s(query_id, doc_id, score) for a query table (query_id, text)."""
    return f"""WITH {TF}, {IDF}, q AS ({queries}),
qt AS (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM q),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
qw AS (SELECT query_id, term, qtf * idf AS w FROM qtf JOIN idf USING (term) WHERE idf <> 0),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query_id),
s AS (SELECT query_id, doc_id, sum(w * tf.tf * idf.idf) / (any_value(norm) * any_value(qnorm)) AS score
      FROM qw JOIN tf USING (term) JOIN idf USING (term) JOIN norms USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)"""


def sql_top(source: str, k: int, key: str = "doc_id") -> str:
    return f"""SELECT query_id, {key}, score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (SELECT query_id, {key}, round(score, 6) AS score FROM {source})) WHERE rank <= {k}"""


def sql_words() -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, '{w}' AS text" for i, w in enumerate(WORDS))


COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


# text: tokens, frequencies, weights


@query(f"SELECT doc_id, pos - 1 AS pos, term FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents))")
def token_stream(spark, sf_dir):
    return long_columns(index.token_stream(docs(spark, sf_dir)), "pos")


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def doc_term_freq(spark, sf_dir):
    return index.term_frequencies(docs(spark, sf_dir))


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf WHERE term NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})")
def stopword_filter(spark, sf_dir):
    return index.term_frequencies(docs(spark, sf_dir), STOP_WORDS)


@query(f"WITH {TF}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark, sf_dir):
    d = docs(spark, sf_dir)
    return index.document_frequency(index.term_frequencies(d), d.count(), "term").withColumn("idf", F.round("idf", 6))


@query(f"WITH {TF}, {IDF} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def doc_norms(spark, sf_dir):
    return text_index(spark, sf_dir).norms.withColumn("norm", F.round("norm", 6))


VOCABULARY = f"""SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)"""


@query(f"SELECT term, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := pos))) - 1 AS word_id FROM ({VOCABULARY}) GROUP BY term")
def vocab_first_seen(spark, sf_dir):
    return index.vocabulary(docs(spark, sf_dir))


SQL_CODEBOOK = f"""b AS (SELECT term, count(*) AS cf, min(struct_pack(d := doc_id, p := pos)) AS first FROM ({VOCABULARY}) GROUP BY term),
c AS (SELECT row_number() OVER (ORDER BY cf DESC, first) - 1 AS codeword_id, term, cf FROM b QUALIFY codeword_id < 1000)"""


@query(f"WITH {SQL_CODEBOOK} SELECT codeword_id, term, cf FROM c")
def text_codebook_topk(spark, sf_dir):
    return index.text_codebook(docs(spark, sf_dir))


@query(f"WITH {TF}, {SQL_CODEBOOK} SELECT doc_id, codeword_id, tf FROM tf JOIN c USING (term)")
def text_histogram(spark, sf_dir):
    seen = index.kept(index.term_occurrences(docs(spark, sf_dir)))
    return index.codewords(seen, index.kept(index.codebook_of(seen))).select("doc_id", "codeword_id", "tf")


@query(
    f"""WITH {TF}, {SQL_CODEBOOK}, h AS (SELECT doc_id, map(list(codeword_id), list(tf)) AS m FROM tf JOIN c USING (term) GROUP BY doc_id)
SELECT doc_id, array_to_string(list_transform(range(1000), lambda i: coalesce(m[i], 0)), ',') AS histogram FROM h"""
)
def text_histogram_dense(spark, sf_dir):
    d = docs(spark, sf_dir)
    seen = index.kept(index.term_occurrences(d))
    found = index.dense(index.codewords(seen, index.kept(index.codebook_of(seen))), 1000)
    return found.select("doc_id", F.array_join(F.transform("histogram", lambda x: x.cast("long").cast("string")), ",").alias("histogram"))


@query(f"WITH {TF} SELECT term, (doc_id // {index.POSTING_RANGE})::BIGINT AS block, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf GROUP BY ALL")
def posting_lists(spark, sf_dir):
    lists = index.posting_lists(index.term_frequencies(docs(spark, sf_dir)))
    return lists.select("term", "block", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), ",").alias("postings"))


@query(f"WITH {TF} SELECT term, doc_id, (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END * tf)::BIGINT AS tf FROM tf")
def posting_upsert(spark, sf_dir):
    """Documents divisible by three come twice."""
    tf = index.term_frequencies(docs(spark, sf_dir))
    return index.add_postings(tf.select("term", "doc_id", "tf"), tf.where("doc_id % 3 = 0").select("term", "doc_id", "tf"))


# search


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark WHERE item_id = 0") + sql_top("s", 10))
def tfidf_topk(spark, sf_dir):
    return ranking.top_k(index.score(text_index(spark, sf_dir), query_tf(benchmark(spark, sf_dir, "item_id = 0"))), 10, digits=6)


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark") + sql_top("s", 50))
def tfidf_topk_batch(spark, sf_dir):
    return ranking.top_k(index.score(text_index(spark, sf_dir), query_tf(benchmark(spark, sf_dir))), 50, digits=6)


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark") + sql_top("s", 50))
def tfidf_linear(spark, sf_dir):
    tf = kept_frequencies(spark, sf_dir)
    return ranking.top_k(index.score_linear(tf, query_tf(benchmark(spark, sf_dir)), docs(spark, sf_dir).count()), 50, digits=6)


@query(
    sql_scores("SELECT item_id AS query_id, text FROM benchmark")
    .replace("tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)", f"{SQL_CODEBOOK},\ntf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM c) GROUP BY ALL)")
    + sql_top("s", 10)
)
def spimi_text_search(spark, sf_dir):
    """Search over the 1000-term codebook, as the engine's index has it."""
    d = docs(spark, sf_dir)
    seen = index.kept(index.term_occurrences(d))
    tf = seen.drop("first").join(index.kept(index.codebook_of(seen)).select("term"), "term")
    return ranking.top_k(index.score(index.build_index(tf, d.count()), query_tf(benchmark(spark, sf_dir))), 10, digits=6)


MATCH = f"""q AS ({sql_words()}), qt AS (SELECT DISTINCT query_id, unnest({sql_tokens('text')}) AS term FROM q),
need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY query_id),
m AS (SELECT query_id, doc_id FROM qt JOIN tf USING (term) JOIN need USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = any_value(need))"""


@query(f"WITH {TF}, {MATCH} SELECT query_id, doc_id FROM m")
def fts_and_match(spark, sf_dir):
    return fulltext.match_all(index.term_frequencies(docs(spark, sf_dir)), query_tf(tables.query_frame(spark, WORDS)))


@query()
def fts_ranked(spark, sf_dir):
    return ranking.top_k(fulltext.search_all(text_index(spark, sf_dir), query_tf(tables.query_frame(spark, WORDS))), 50, digits=6)


ORACLES["fts_ranked"] = (
    sql_scores(sql_words())
    + f""", dq AS (SELECT DISTINCT query_id, term FROM qt), need AS (SELECT query_id, count(*) AS need FROM dq GROUP BY query_id),
m AS (SELECT query_id, doc_id FROM dq JOIN tf USING (term) JOIN need USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = any_value(need)),
r AS (SELECT m.query_id, m.doc_id, coalesce(score, 0) AS score FROM m LEFT JOIN s ON s.query_id = m.query_id AND s.doc_id = m.doc_id)"""
    + sql_top("r", 50)
)


SQL_STOP = ", ".join(repr(w) for w in STOP_WORDS)
SQL_PLACES = f"""pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)),
tf AS (SELECT doc_id, term, list(pos ORDER BY pos) AS places FROM pos WHERE term NOT IN ({SQL_STOP}) GROUP BY ALL)"""


@query(f"WITH {SQL_PLACES} SELECT doc_id, term, array_to_string(places, ',') AS positions FROM tf")
def fts_positions(spark, sf_dir):
    found = fulltext.positions(docs(spark, sf_dir), STOP_WORDS)
    return found.select("doc_id", "term", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def _near_queries(spark, sf_dir):
    """Every benchmark text, the two words it opens with, and a few fixed strings."""
    asked = benchmark(spark, sf_dir)
    words = T.tokens(F.col("text"))
    pairs = asked.where(F.size(words) > 1).select(F.col("query_id") + 1_000_000, F.concat_ws(" ", F.slice(words, 1, 2)).alias("text"))
    fixed = tables.query_frame(spark, WORDS).select((F.col("query_id") - len(WORDS)).alias("query_id"), "text")
    return asked.unionAll(pairs).unionAll(fixed)


SQL_NEAR = f"""WITH {SQL_PLACES}, words AS (SELECT item_id, {sql_tokens('text')} AS w FROM benchmark),
q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000000 + item_id, w[1] || ' ' || w[2] FROM words WHERE len(w) > 1 UNION ALL SELECT query_id - {len(WORDS)}, text FROM ({sql_words()})),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM q) WHERE term NOT IN ({SQL_STOP})),
need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY query_id),
m AS (SELECT query_id, doc_id, any_value(need) AS need FROM asked JOIN tf USING (term) JOIN need USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = any_value(need)),
p AS (SELECT query_id, doc_id, need, term, unnest(places) AS pos FROM m JOIN asked USING (query_id) JOIN tf USING (doc_id, term)),
near AS (SELECT a.query_id, a.doc_id, 1 - exp(sum(ln(1 - 0.1 / sqrt(1.005 + 0.05 * exp((b.pos - a.pos) / 1.5 - 2))))) AS score
         FROM p a JOIN p b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.term <> b.term AND b.pos > a.pos AND b.pos <= a.pos + 100 GROUP BY ALL),
alone AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (n * n)) * 0.1 / 1.64493406685 AS score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id) AS n FROM p WHERE need = 1) GROUP BY ALL),
s AS (SELECT query_id, doc_id, coalesce(near.score, alone.score, 0) AS score FROM m LEFT JOIN near USING (query_id, doc_id) LEFT JOIN alone USING (query_id, doc_id))"""


@query(SQL_NEAR + sql_top("s", 50))
def fts_proximity(spark, sf_dir):
    """Documents with all lexemes of a query, by how near these stand."""
    path = sinks.scratch_path(spark)
    sinks.write_table(fulltext.positions(docs(spark, sf_dir), STOP_WORDS), path)
    asked = fulltext.query_lexemes(_near_queries(spark, sf_dir), STOP_WORDS)
    return ranking.top_k(fulltext.search_near(spark.read.parquet(path), asked), 50, digits=6)


def _signed(spark, sf_dir):
    """Signatures of all documents and of all queries, both written."""
    paths = [sinks.scratch_path(spark) for _ in range(2)]
    words = docs(spark, sf_dir).select("doc_id", F.explode(T.without(T.tokens(F.col("text")), STOP_WORDS)).alias("term"))
    sinks.write_table(signatures.signatures(words), paths[0])
    sinks.write_table(signatures.wanted(fulltext.query_lexemes(_near_queries(spark, sf_dir), STOP_WORDS)), paths[1])
    return [spark.read.parquet(p) for p in paths]


@query(SQL_NEAR + " SELECT query_id, doc_id FROM m")
def fts_signature_match(spark, sf_dir):
    """Documents with all lexemes of a query, by signatures and a recheck."""
    signed, asked = _signed(spark, sf_dir)
    return signatures.recheck(signatures.candidates(signed, asked), signed, asked)


@query(
    SQL_NEAR
    + """, db AS (SELECT DISTINCT doc_id, ('0x' || md5(term)[1:8])::BIGINT % 1024 AS bit FROM tf), qb AS (SELECT DISTINCT query_id, ('0x' || md5(term)[1:8])::BIGINT % 1024 AS bit FROM asked),
nb AS (SELECT query_id, count(*) AS bits FROM qb GROUP BY query_id), c AS (SELECT query_id, doc_id FROM qb JOIN db USING (bit) JOIN nb USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = any_value(bits))
SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM m) AS matches, round(1 - (SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM c), 6) AS false_share"""
)
def fts_signature_share(spark, sf_dir):
    """How many candidates the signatures leave, how many match, and the share looked at in vain."""
    signed, asked = _signed(spark, sf_dir)
    found = signatures.candidates(signed, asked)
    path = sinks.scratch_path(spark)
    sinks.write_table(found, path)
    found = spark.read.parquet(path)
    n, m = found.agg(F.count("*").alias("candidates")), signatures.recheck(found, signed, asked).agg(F.count("*").alias("matches"))
    counts = n.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one")
    return counts.select("candidates", "matches", F.round(1 - F.col("matches") / F.col("candidates"), 6).alias("false_share"))


@query(f"WITH {TF} SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS lexemes FROM tf GROUP BY doc_id")
def tsvector(spark, sf_dir):
    return fulltext.lexemes(index.term_frequencies(docs(spark, sf_dir))).select("doc_id", F.array_join("lexemes", " ").alias("lexemes"))


@query(sql_scores("SELECT item_id AS query_id, text FROM benchmark") + f", r AS ({sql_top('s', 100)}) SELECT query_id, doc_id, score, rank FROM r WHERE rank > 20 AND rank <= 30")
def paginate(spark, sf_dir):
    ranked = ranking.top_k(index.score(text_index(spark, sf_dir), query_tf(benchmark(spark, sf_dir))), 100, digits=6)
    return ranking.page(ranked, 2, 10)


@query(
    sql_scores("SELECT item_id AS query_id, text FROM benchmark")
    + """ SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
FROM s WINDOW w AS (PARTITION BY query_id)"""
)
def minmax_normalise(spark, sf_dir):
    scored = index.score(text_index(spark, sf_dir), query_tf(benchmark(spark, sf_dir)))
    return ranking.min_max(scored).withColumn("score", F.round("score", 6))


# vectors

SQL_VQ = f"""cb AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < {CODEBOOK}),
d AS (SELECT v.vec_id AS doc_id, c, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::DOUBLE * e[i]::DOUBLE - 2 * e[i]::DOUBLE * v.embedding[i]::DOUBLE)), 9) AS dist FROM embeddings v, cb),
vq AS (SELECT doc_id, arg_min(c, struct_pack(d := dist, c := c)) AS codeword_id FROM d GROUP BY doc_id)"""


@query(f"WITH {SQL_VQ} SELECT doc_id, codeword_id FROM vq")
def vq_assign(spark, sf_dir):
    c = centres(spark, sf_dir, CODEBOOK)
    return vectors(spark, sf_dir).select("doc_id", nearest_codeword(F.col("embedding"), c).cast("long").alias("codeword_id"))


@query(f"WITH {SQL_VQ} SELECT label::BIGINT AS doc_id, codeword_id, count(*) AS tf FROM vq JOIN embeddings ON vec_id = doc_id GROUP BY ALL")
def visual_histogram(spark, sf_dir):
    """Vectors as descriptors, labels as the images they are from."""
    c = centres(spark, sf_dir, CODEBOOK)
    return index.visual_frequencies(vectors(spark, sf_dir).selectExpr("CAST(label AS bigint) AS doc_id", "embedding"), c)


VISUAL = f"""WITH {SQL_VQ}, tf AS (SELECT (doc_id // 5) AS doc_id, codeword_id AS term, count(*) AS tf FROM vq GROUP BY ALL),
n AS (SELECT count(DISTINCT vec_id // 5) AS n FROM embeddings),
idf AS (SELECT term, ln((SELECT n FROM n)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id),
qw AS (SELECT doc_id AS query_id, term, tf * idf AS w FROM tf JOIN idf USING (term) WHERE idf <> 0 AND doc_id % 20 = 0),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query_id),
s AS (SELECT query_id, doc_id, sum(w * tf.tf * idf.idf) / (any_value(norm) * any_value(qnorm)) AS score
      FROM qw JOIN tf USING (term) JOIN idf USING (term) JOIN norms USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)"""


@query(VISUAL + sql_top("s", 10))
def visual_tfidf_topk(spark, sf_dir):
    """Five vectors in a row as the descriptors of one image."""
    c = centres(spark, sf_dir, CODEBOOK)
    images = vectors(spark, sf_dir).selectExpr("doc_id div 5 AS doc_id", "embedding")
    tf = index.kept(index.visual_frequencies(images, c))
    built = index.build_index(tf, images.select("doc_id").distinct().count(), "codeword_id")
    asked = tf.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return knn.nearest_histograms(built, asked, CODEBOOK, 10)


SQL_KNN = f"SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {COS.format(a='q.embedding', b='v.embedding')} AS score FROM embeddings v, embeddings q WHERE "


@query(f"WITH s AS ({SQL_KNN} q.vec_id % 20 = 0)" + sql_top("s", 10))
def knn_cosine_exact(spark, sf_dir):
    return knn.knn_exact(vectors(spark, sf_dir), vector_queries(spark, sf_dir, "doc_id % 20 = 0"), 10)


@query(f"WITH s AS ({SQL_KNN} q.vec_id % 20 = 0)" + sql_top("s", 50))
def knn_cosine_batch(spark, sf_dir):
    return knn.knn_exact(vectors(spark, sf_dir), vector_queries(spark, sf_dir, "doc_id % 20 = 0"), 50)


SQL_LISTS = f"""cb AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < {LISTS}),
d AS (SELECT v.vec_id, c, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::DOUBLE * e[i]::DOUBLE - 2 * e[i]::DOUBLE * v.embedding[i]::DOUBLE)), 9) AS dist FROM embeddings v, cb),
home AS (SELECT vec_id, arg_min(c, struct_pack(d := dist, c := c)) AS list_id FROM d GROUP BY vec_id),
probe AS (SELECT vec_id AS query_id, c AS list_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS r FROM d WHERE vec_id % 20 = 0) WHERE r <= 8),
s AS (SELECT query_id, v.vec_id AS doc_id, {COS.format(a='q.embedding', b='v.embedding')} AS score
      FROM probe JOIN home USING (list_id) JOIN embeddings v ON v.vec_id = home.vec_id JOIN embeddings q ON q.vec_id = query_id)"""


@query(f"WITH {SQL_LISTS}" + sql_top("s", 10))
def ivf_knn(spark, sf_dir):
    c = centres(spark, sf_dir, LISTS)
    return knn.knn_ivf(knn.assign_lists(vectors(spark, sf_dir), c), vector_queries(spark, sf_dir, "doc_id % 20 = 0"), c, 10, probes=8)


@query()
def lsh_knn(spark, sf_dir):
    signed = knn.with_signatures(vectors(spark, sf_dir))
    return knn.knn_lsh(signed, vector_queries(spark, sf_dir, "doc_id % 20 = 0"), 10)


@query()
def graph_knn(spark, sf_dir):
    """Layered graphs, written and read back; ``graph_recall`` measures them."""
    path = sinks.scratch_path(spark)
    graph.write_graph(graph.build_graph(vectors(spark, sf_dir)), path)
    return graph.knn_graph(spark.read.parquet(path), vector_queries(spark, sf_dir, "doc_id % 20 = 0"), 10)


@query()
def minibatch_codebook(spark, sf_dir):
    """Centres of batches in order of doc_id, with the vectors that came to each."""
    found = index.minibatch_codebook(vectors(spark, sf_dir), sinks.scratch_path(spark), CODEBOOK, batch=256)
    return spark.createDataFrame([(i, int(n), [float(x) for x in c]) for i, (n, c) in enumerate(zip(found.counts, found.centres, strict=True))], "codeword_id long, n long, centre array<double>")


@query()
def kmeans_codebook(spark, sf_dir):
    c = index.kmeans_codebook(vectors(spark, sf_dir), CODEBOOK)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(c)], "codeword_id long, centre array<double>")


# fusion: the label of a vector query is its item's number in both lists

FUSED = sql_scores("SELECT item_id AS query_id, text FROM benchmark") + f", v AS ({SQL_KNN} q.vec_id IN (SELECT item_id FROM benchmark))"


def _sides(spark, sf_dir):
    """Scores of every benchmark text, and of the vector of its number, against all documents and vectors."""
    asked = benchmark(spark, sf_dir)
    scored = index.score(text_index(spark, sf_dir), query_tf(asked)).withColumn("score", F.round("score", 6))
    q = vector_queries(spark, sf_dir, "true").join(asked.select("query_id"), "query_id", "left_semi")
    near = knn.knn_exact(vectors(spark, sf_dir), q, None).select("query_id", "doc_id", "score")
    return scored, near


@query(
    FUSED
    + """, f AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, 0.6 * round(score, 6) AS score FROM s UNION ALL SELECT query_id, doc_id, 0.4 * round(score, 6) FROM v) GROUP BY ALL)"""
    + sql_top("f", 20)
)
def fuse_full(spark, sf_dir):
    return ranking.top_k(ranking.fuse(*_sides(spark, sf_dir), 60, 40), 20, digits=6)


def _fused_top(spark, sf_dir):
    asked = benchmark(spark, sf_dir)
    images = vector_queries(spark, sf_dir, "true").join(asked.select("query_id"), "query_id", "left_semi")
    return threshold.fuse_top(asked, threshold.text_side(text_index(spark, sf_dir), query_tf(asked)), threshold.vector_side(vectors(spark, sf_dir), images), 60, 40, 20)


@query(ORACLES["fuse_full"])
def fuse_threshold(spark, sf_dir):
    """The rows of ``fuse_full`` from the upper ends of both lists."""
    return _fused_top(spark, sf_dir).drop("read")


@query()
def fuse_threshold_read(spark, sf_dir):
    """How many list entries each query took, beside those that there are vectors and documents."""
    every = docs(spark, sf_dir).count() + vectors(spark, sf_dir).count()
    return _fused_top(spark, sf_dir).groupBy("query_id").agg(F.max("read").alias("read")).withColumn("entries", F.lit(every))


@query(
    FUSED
    + """, s2 AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 1000),
v2 AS (SELECT query_id, doc_id, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 1000),
f AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, 0.6 * score AS score FROM s2 UNION ALL SELECT query_id, doc_id, 0.4 * score FROM v2) GROUP BY ALL)"""
    + sql_top("f", 20)
)
def fuse_truncated(spark, sf_dir):
    """Each side cut at its 1000 best before fusion."""
    return ranking.top_k(ranking.fuse(*_sides(spark, sf_dir), 60, 40, truncate=1000), 20, digits=6)


# records, cleaning, updates

RECORD = ["p_brand", "p_type", "p_size", "p_name", "p_retailprice"]
SQL_RECORD = "coalesce(p_brand, 'nan') || '|' || coalesce(p_type, 'nan') || '|' || coalesce(p_size::VARCHAR, 'nan') || '|' || coalesce(p_name, 'nan') || '|extra'"


def _records(spark, sf_dir):
    packed = T.pack_record([*(F.col(c) for c in RECORD[:4]), F.lit("extra")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), packed.alias("text"))


@query(
    "SELECT p_partkey AS doc_id, r AS text, "
    + ", ".join(f"coalesce(split_part(r, '|', {i + 1}), '') AS {n}" for i, n in enumerate(T.FIELDS))
    + f" FROM (SELECT p_partkey, {SQL_RECORD} AS r FROM part)"
)
def pipe_pack_unpack(spark, sf_dir):
    return _records(spark, sf_dir).withColumn("f", T.unpack_record(F.col("text"))).select("doc_id", "text", "f.*")


@query("SELECT p_partkey AS doc_id, coalesce(p_size::VARCHAR, 'nan') AS label FROM part")
def subcategory_map(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", T.sub_category(F.col("text")).alias("label"))


@query(
    f"""WITH r AS (SELECT p_partkey AS doc_id, {SQL_RECORD} AS t, p_retailprice / 1500 AS score FROM part),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 50)
SELECT 0::BIGINT AS query_id, rank, doc_id::VARCHAR AS id, 'Unknown' AS name, trunc(score * 100)::INT::VARCHAR || '%' AS match_percentage, 'u' || doc_id AS image_url FROM k"""
)
def result_format(spark, sf_dir):
    d = _records(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), "doc_id"))
    scored = table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("query_id"), F.col("p_partkey").alias("doc_id"), (F.col("p_retailprice") / 1500).alias("score"))
    return engine.formatted(engine.enriched(ranking.top_k(scored, 50), d))


@query(f"SELECT p_partkey::VARCHAR AS id, 'u' || p_partkey AS image_url, p_brand AS gender, p_size::VARCHAR AS sub_category, '' AS product_name FROM part WHERE p_partkey = 7")
def product_details(spark, sf_dir):
    d = _records(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), "doc_id"))
    return engine.details(d, 7).select("id", "image_url", "attributes.gender", "attributes.sub_category", "attributes.product_name")


@query("SELECT page_id, url FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0")
def clean_undefined(spark, sf_dir):
    link = F.when(F.col("page_id") % 7 == 0, F.lit(" Undefined ")).when(F.col("page_id") % 11 != 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("url")).where(T.is_defined(F.col("url")))


@query("SELECT page_id, page_id::INT AS id, 'images/' || page_id || '.jpg' AS path FROM pages")
def extract_id(spark, sf_dir):
    name = F.concat("url", F.lit("/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "pages").select("page_id", T.file_id(name).alias("id"), T.local_path("images", name).alias("path"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_filter(spark, sf_dir):
    return tables.existing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'new' ELSE coalesce(d.source, '') END AS url,
CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE coalesce(d.lang, '') END AS text FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS url", "lang AS text")
    new = table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'new' ELSE '' END AS url", "concat('q', quality) AS text")
    return sinks.upsert(old, new)


@query("SELECT p_size::BIGINT AS doc_id, coalesce(arg_max(p_brand, p_partkey) FILTER (WHERE p_partkey % 2 = 0), '') AS url, arg_max(p_name, p_partkey) AS text FROM part GROUP BY p_size")
def batch_latest(spark, sf_dir):
    batch = table(spark, sf_dir, "part").selectExpr("CAST(p_size AS bigint) AS doc_id", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS url", "p_name AS text", "p_partkey AS seq")
    return sinks.latest(batch, "seq")


@query("SELECT l.doc_id, CASE WHEN e.vec_id IS NULL THEN NULL ELSE round(e.embedding[1]::DOUBLE, 6) END AS first FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id AND e.label < 5")
def histogram_update(spark, sf_dir):
    h = vectors(spark, sf_dir).where("label < 5").selectExpr("doc_id", "embedding AS histogram")
    out = sinks.set_histograms(table(spark, sf_dir, "labels").select("doc_id"), h, "image_histogram", 64)
    return out.select("doc_id", F.round(F.get("image_histogram", 0).cast("double"), 6).alias("first"))


# evaluation and statistics


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return evaluate.label_counts(v, v)


@query(
    f"""WITH s AS ({SQL_KNN} q.vec_id % 20 = 0), r AS ({sql_top('s', 50)}),
t AS (SELECT label, count(*) AS total FROM embeddings GROUP BY label),
h AS (SELECT r.query_id, count(*) FILTER (WHERE v.label = q.label) AS hits, any_value(q.label) AS label FROM r JOIN embeddings v ON v.vec_id = r.doc_id JOIN embeddings q ON q.vec_id = r.query_id GROUP BY r.query_id)
SELECT query_id, round(hits / 50.0, 6) AS precision, round(hits / total, 6) AS recall FROM h JOIN t USING (label)"""
)
def precision_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ranked = knn.knn_exact(v, vector_queries(spark, sf_dir, "doc_id % 20 = 0"), 50)
    expected = v.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "label")
    return evaluate.precision_recall(ranked, v, expected, 50).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT p_type, p_size::BIGINT AS p_size, round(avg(p_retailprice), 6) AS p_retailprice_avg FROM part GROUP BY ALL")
def bench_averages(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select("p_type", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    return evaluate.averages(runs, ["p_type", "p_size"], ["p_retailprice"]).withColumn("p_retailprice_avg", F.round("p_retailprice_avg", 6))


CF = f"WITH {TF}, cf AS (SELECT term, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)"


@query(f"{CF} SELECT count(*) AS vocabulary, sum(cf)::BIGINT AS occurrences, count(*) FILTER (WHERE cf = 1) AS hapax, round(count(*) FILTER (WHERE cf = 1) * 100.0::DOUBLE / count(*), 2) AS hapax_pct FROM cf")
def bow_stats(spark, sf_dir):
    return evaluate.bow_stats(index.term_frequencies(docs(spark, sf_dir)))


@query(
    f"""{CF}, r AS (SELECT cf, row_number() OVER (ORDER BY cf DESC) AS r FROM cf)
SELECT k, round(sum(cf) FILTER (WHERE r <= k) * 100.0::DOUBLE / sum(cf), 2) AS coverage_pct FROM r, (SELECT unnest([10, 50, 100, 200, 500, 1000, 2000, 5000])::BIGINT AS k) GROUP BY k"""
)
def coverage_curve(spark, sf_dir):
    return evaluate.coverage_curve(index.term_frequencies(docs(spark, sf_dir)))


@query(
    f"""{CF} SELECT bucket, count(term) AS terms FROM (SELECT * FROM (VALUES ('1', 1, 1), ('2-5', 2, 5), ('6-20', 6, 20), ('21-100', 21, 100), ('101-1000', 101, 1000), ('1001+', 1001, 1000000000000)) b(bucket, lo, hi))
LEFT JOIN cf ON cf BETWEEN lo AND hi GROUP BY bucket"""
)
def freq_buckets(spark, sf_dir):
    return evaluate.frequency_buckets(index.term_frequencies(docs(spark, sf_dir)))


# what SQL has no counterpart for


@query()
def chunk_text(spark, sf_dir):
    """Its counterpart is with the other source queries."""
    return chunk_rows(docs(spark, sf_dir))


@query()
def stem_lookup(spark, sf_dir):
    return stem_terms(index.term_frequencies(docs(spark, sf_dir)))


@query()
def engine_multimodal(spark, sf_dir):
    """The facade end to end: stemmed chunks, both indexes, fusion, records."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS url", "text")
    built = engine.Engine.build(spark, d, vectors(spark, sf_dir), centres(spark, sf_dir, CODEBOOK))
    asked = benchmark(spark, sf_dir)
    return built.search(asked, vector_queries(spark, sf_dir, "true").join(asked.select("query_id"), "query_id", "left_semi"), k=10)
