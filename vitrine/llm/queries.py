"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from .common import documents, labels
from .divergence import divergence
from .fingerprint import edited_fingerprints
from .mixing import mix_sources
from .neardup import near_duplicates
from .ngrams import language_model_scores
from .packing import pack
from .phrases import collocations
from .pii import find_pii
from .quality import classify_quality
from .repeats import remove_repeats
from .secrets import scan_secrets
from .topk import search
from .toxicity import classify_toxicity

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY (source IS NULL), source) - 1 AS rnk
      FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rnk % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(
        (SELECT arg_min(lev, (cap / weight, rnk)) FROM l WHERE lev * weight <= cap) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS e,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, floor(target - e * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM p
"""


@query
def op2_fingerprints(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))


@query
def op9_remove_repeats(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


@query
def op5_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


@query
def op1_pii(spark, sf_dir):
    return find_pii(documents(spark, sf_dir))


@query
def op6_secrets(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))


@query
def op4_quality(spark, sf_dir):
    return classify_quality(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op8_toxicity(spark, sf_dir):
    return classify_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


@query
def op10_topk_search(spark, sf_dir):
    """Every benchmark text whose item_id is divisible by 20, against all documents."""
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 20 = 0").selectExpr("item_id AS query_id", "text")
    return search(documents(spark, sf_dir), asked)


ORACLES["op10_topk_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d),
tf AS (SELECT doc_id, dl, t, count(*)::DOUBLE AS f FROM p GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS av FROM d),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, t, count(*)::DOUBLE AS qf FROM q GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 9) AS score
      FROM qt JOIN df USING (t) JOIN tf USING (t), n GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op10_topk_documents(spark, sf_dir):
    """Every document whose doc_id is divisible by 20, as a query against all documents."""
    docs = documents(spark, sf_dir)
    return search(docs, docs.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text"))


ORACLES["op10_topk_documents"] = ORACLES["op10_topk_search"].replace("item_id", "doc_id").replace("FROM benchmark", "FROM documents")


@query
def op11_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


ORACLES["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT e.lang, e.source, coalesce(s.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_ngram_scores(spark, sf_dir):
    return language_model_scores(documents(spark, sf_dir)).drop("perplexity")


def sql_crc32(text: str) -> str:
    """The checksum bit by bit, as DuckDB has no function for it."""
    byte = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), lambda c, b: {byte}), 4294967295)"


ORACLES["op12_ngram_scores"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS i, {sql_crc32("doc_id::VARCHAR")} % 7 = 2 AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
tok AS (SELECT i, held_out, unnest(words || [' ']) AS w, unnest([''] || words) AS v FROM d),
u AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
s AS (SELECT sum(c)::BIGINT AS n, count(*) AS kinds FROM u),
b AS (SELECT v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY ALL),
k AS (SELECT w, count(*) AS c FROM b GROUP BY w),
x AS (SELECT v, sum(c) AS total, count(*) FILTER (c = 1) AS a1, count(*) FILTER (c = 2) AS a2, count(*) FILTER (c > 2) AS a3 FROM b GROUP BY v),
t AS (SELECT 1 AS level, c FROM k UNION ALL SELECT 2, c FROM b),
o AS (SELECT level, count(*) FILTER (c = 1)::DOUBLE AS t1, count(*) FILTER (c = 2) AS t2, count(*) FILTER (c = 3) AS t3, count(*) FILTER (c = 4) AS t4,
             count(*) FILTER (c > 2) AS more, sum(c) AS total, count(*) AS kinds FROM t GROUP BY level),
e AS (SELECT *, 1 - 2 * t1 / (t1 + 2 * t2) * t2 / t1 AS d1, 2 - 3 * t1 / (t1 + 2 * t2) * t3 / t2 AS d2, 3 - 4 * t1 / (t1 + 2 * t2) * t4 / t3 AS d3 FROM o),
f AS (SELECT level, t1, t2, more, total, kinds, unnest([CASE WHEN least(t1, t2, t3, t4) > 0 AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 THEN [0, d1, d2, d3] ELSE [0, 0.5, 1, 1.5] END]) AS d FROM e),
p AS (SELECT tok.i, coalesce(u.c, 0) AS c, (greatest(coalesce(k.c, 0) - f1.d[least(coalesce(k.c, 0), 3) + 1], 0) + (f1.d[2] * f1.t1 + f1.d[3] * f1.t2 + f1.d[4] * f1.more) / (f1.kinds + 1)) / f1.total AS p1,
             greatest(coalesce(b.c, 0) - f2.d[least(coalesce(b.c, 0), 3) + 1], 0) AS c2, x.total, f2.d[2] * a1 + f2.d[3] * a2 + f2.d[4] * a3 AS spared
      FROM tok LEFT JOIN u USING (w) LEFT JOIN k USING (w) LEFT JOIN b USING (v, w) LEFT JOIN x USING (v), (SELECT * FROM f WHERE level = 1) f1, (SELECT * FROM f WHERE level = 2) f2),
r AS (SELECT i, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, fsum(log10((c + 1) / (n + kinds + 1))) AS base, fsum(log10(CASE WHEN total > 0 THEN (c2 + spared * p1) / total ELSE p1 END)) AS score
      FROM p, s GROUP BY i)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 9) AS base_score, round(score, 9) AS score FROM d JOIN r USING (i), s
"""


@query
def op13_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND contains(phrase, ' ')),
k AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < len(w)),
s AS (SELECT k.lang, k.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')]) AS phrase, phrase AS longer FROM c WHERE len(w) > 2),
x AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN i ON i.lang = c.lang AND i.phrase = c.phrase AND i.longer <> c.phrase WHERE 100 * i.a >= 80 * c.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
               FROM s ANTI JOIN x USING (lang, phrase) JOIN n USING (lang)) WHERE rank <= 2000
"""
