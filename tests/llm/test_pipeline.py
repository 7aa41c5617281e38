import random

import pytest

import corpus_pipeline
from vitrine.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "the in ri ga wo le ma su si pa sto mu".split() for b in "ver den low ter ket mer ply".split()]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randint(20, 90)))
        bad = i % 6 == 0
        rows.append([i, text.upper().replace(" ", "!! ") if bad else text, "en", f"s{i % 3}", 0])
        labels.append((i, int(not bad), 0))
    for i in range(240, 260):  # copies, and personal data
        rows.append([i, rows[i - 239][1], "en", "s1", 0])
    rows[1][1] += " write to someone@mail.example.org today"
    rows.append([300, None, None, None, 0])
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, folder))
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "packing"
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert len([i for i in range(240) if i % 6 == 0 and i in ids["quality"]]) <= 4  # rejected
    assert len([i for i in range(240) if i % 6 and i in ids["quality"]]) >= 196  # clean ones stay
    assert not ids["near_duplicates"] & set(range(242, 260)) and {i for i in ids["quality"] if 30 < i < 240} <= ids["near_duplicates"]
    assert not any("@" in (r.text or "") for r in kept["pii"]) and ids["pii"] == ids["near_duplicates"]
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(kept["mix"]) - 1.5 * words(kept["pii"])) <= 4
    assert {r.doc_id for r in kept["packing"]} == ids["mix"]
    run = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in run.collect()) == sum(r.length for r in kept["packing"])


def test_stages_of_odd_tables(spark, folder):
    """No rows, nothing but nulls, and columns whose names clash with those inside the stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, docs.schema)
    odd = docs.limit(30).selectExpr("*", "doc_id AS `a.b`", "text AS doc", "1 AS node", "2 AS score", "3 AS row", "4 AS base", "5 AS _doc", "6 AS size")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert stage(spark, nulls, folder).count() == {"near_duplicates": 1, "mix": 0}.get(name, 3), name
        out = stage(spark, odd, folder)
        assert out.count() > 0 and (name == "packing" or out.columns == odd.columns), name


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and ORACLES.keys() <= QUERIES.keys()
