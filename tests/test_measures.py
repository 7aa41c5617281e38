"""Word signatures against the plain match, and the measures of runs."""

import itertools

import pytest

from vitrine.operators import fulltext, signatures
from vitrine.plans import benchmark
from vitrine.plans.engine import Engine


def words(spark, rows, key):
    return spark.createDataFrame([(i, t) for i, text in rows for t in text.split()], f"{key} long, term string")


@pytest.mark.parametrize("bits", [64, 1024])
def test_signatures_match_as_lexemes_do(spark, tmp_path, bits):
    """With one long most bits are set, and many candidates fall to the recheck."""
    tf = words(spark, [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(i % 40))) for i in range(300)], "doc_id")
    asked = words(spark, [(q, f"w{q} w{(q * 3) % 97} w{q}") for q in range(60)] + [(90, "w3 nowhere"), (91, "w5")], "query_id")
    signatures.signatures(tf.unionAll(tf), bits).write.parquet(str(tmp_path / "signed"))
    signatures.wanted(asked, bits).write.parquet(str(tmp_path / "asked"))
    signed, queries = (spark.read.parquet(str(tmp_path / n)) for n in ("signed", "asked"))
    found = {tuple(r) for r in signatures.candidates(signed, queries).collect()}
    want = {tuple(r) for r in fulltext.match_all(tf.distinct(), asked).collect()}
    assert want and want <= found and (bits > 64 or len(found) > 2 * len(want))
    again = signatures.match_signed(signed, asked).collect()
    assert len(again) == len(want) and {tuple(r) for r in again} == want
    held = {r.doc_id: r.signature for r in signed.collect()}
    plain = {q.query_id: q.signature for q in queries.collect()}
    covered = {(q, d) for (q, a), (d, b) in itertools.product(plain.items(), held.items()) if all(x & y == x for x, y in zip(a, b, strict=True))}
    assert covered == found


def test_signatures_of_nothing(spark, tmp_path):
    tf = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "doc_id long, term string")
    signatures.signatures(tf).write.parquet(str(tmp_path / "one"))
    signatures.signatures(tf.limit(0)).write.parquet(str(tmp_path / "none"))
    one, none = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "none"))
    asked = words(spark, [(7, "a"), (8, "b")], "query_id")
    assert [tuple(r) for r in signatures.match_signed(one, asked).collect()] == [(7, 1)]
    assert signatures.match_signed(none, asked).count() == 0 and signatures.match_signed(one, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        signatures.signatures(tf, 100)


def test_runs_tell_what_they_read(spark, tmp_path):
    """A scan of a table reads all its rows once a search; a search for what is not there reads too, and answers nothing."""
    rows = spark.range(0, 10_000, 1, 3).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows.write.parquet(str(tmp_path / "docs"))
    kept = spark.read.parquet(str(tmp_path / "docs"))

    def scan(query):
        hits = kept.where(kept.text.endswith(query)).selectExpr("0L AS query_id", "doc_id")
        return hits.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank")

    def twice(query):
        scan(query).write.mode("overwrite").parquet(str(tmp_path / "answers"))
        return spark.read.parquet(str(tmp_path / "answers"))

    labels = kept.selectExpr("doc_id", "'x' AS label")
    costs = []
    cases = [(1, "text", "77", "scan", lambda: scan("77")), (1, "text", "none", "scan", lambda: scan("none")), (1, "text", "77", "written", lambda: twice("77"))]
    runs = benchmark.measured(spark, cases, labels, {"77": "x"}, costs=costs).collect()
    table = benchmark.costed(spark, costs).collect()
    assert [r.rows_read for r in table] == [10_000, 10_000, 10_100]
    assert [r.files for r in table][:2] == [3, 3] and table[2].files > 3
    assert all(r.bytes_read > 0 and r.tasks > 0 and "FileScan parquet" in r.plan for r in table)
    assert table[0].shuffle_bytes > 0 and table[2].jobs > table[0].jobs
    assert [r.io for r in runs] == [-(-r.bytes_read // benchmark.BLOCK) for r in table]
    with benchmark.Measure(spark) as nothing:
        pass
    assert (nothing.jobs, nothing.files, nothing.rows_read) == (0, 0, 0)
