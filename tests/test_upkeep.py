"""Stores that are kept up batch by batch, and engines that are built while others read."""

import numpy as np
import pytest

from vitrine.operators import index
from vitrine.plans import engine
from vitrine.plans.engine import Engine
from vitrine.sources import tables
from vitrine.streaming import upkeep
from vitrine.streaming.upkeep import Store

SCHEMA = 'doc_id long, url string, text string, vectors array<array<double>>, "order" int'.replace('"', "`")
BATCHES = [
    [(1, "u1", "red shirt red", [[1.0, 0.0], [0.9, 0.1]], 0), (2, "u2", "blue shirt", [[0.0, 1.0]], 0), (None, "u", "lost", None, 0), (3, "", "", None, 0)],
    [(1, "", "green shirt", None, 0), (1, "u1b", "green hat", [[0.0, 1.0]], 1), (2, "u2b", "", None, 0), (4, "u4", "red hat", [[1.0, 0.0]], 0)],
    [(2, "", "?!", None, 0), (3, "", "late text", [], 0), (1, None, None, [], 0)],
]


def state(store):
    built = store.index()
    frames = store.descriptors(), store.frequencies(), store.visual(), store.document_frequencies(), built.postings.select("term", "doc_id", "weight"), built.norms
    return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in frames] + [store.size()]


def store_at(spark, path):
    return Store.create(spark, str(path), centres=np.eye(2), stop_words=("late",))


def test_equals_a_rebuild(spark, tmp_path):
    batches = [spark.createDataFrame(b, SCHEMA) for b in BATCHES]
    store = store_at(spark, tmp_path / "a")
    assert state(store) == [[], [], [], [], [], [], 0]
    for i, batch in enumerate(batches):
        store.apply(batch, i)
    found = state(store)
    assert found[0] == [(1, "u1b", "green hat"), (2, "u2b", "?!"), (3, "", "late text"), (4, "u4", "red hat")] and found[-1] == 4
    texts = store.descriptors().select("doc_id", "text")
    tf = index.term_frequencies(texts, ["late"])
    rebuilt = index.build_index(tf, 4)
    assert found[1] == sorted(map(tuple, tf.select("term", "doc_id", "tf").collect()))
    assert found[3] == sorted(map(tuple, rebuilt.idf.select("term", "df").collect()))
    assert found[4] == sorted((r.term, r.doc_id, round(r.weight, 9)) for r in rebuilt.postings.collect())
    assert found[2] == [(0, 4, 1), (1, 2, 1)]  # the empty lists of the last batch took the first image back
    store.compact(1)
    assert state(store) == found and store.through() == 1
    store.apply(batches[0], 0)  # long since summed up
    store.apply(batches[2], 2)  # once more
    assert state(store) == found
    store.compact(2)
    assert state(store) == found


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_batch_that_failed_half_way_runs_again(spark, tmp_path, monkeypatch, fails_at):
    """After each of its sinks in turn."""
    batches = [spark.createDataFrame(b, SCHEMA) for b in BATCHES[:2]]
    want, store = store_at(spark, tmp_path / "a"), store_at(spark, tmp_path / "b")
    for i, batch in enumerate(batches):
        want.apply(batch, i)
    store.apply(batches[0], 0)
    write, done = upkeep.write_table, []

    def failing(table, path):
        if len(done) == fails_at:
            raise RuntimeError("lost")
        done.append(path)
        write(table, path)

    monkeypatch.setattr(upkeep, "write_table", failing)
    with pytest.raises(RuntimeError):
        store.apply(batches[1], 1)
    monkeypatch.setattr(upkeep, "write_table", write)
    store.apply(batches[1], 1)
    assert state(store) == state(want)


def test_stream(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    store, want = store_at(spark, tmp_path / "a"), store_at(spark, tmp_path / "b")
    for i, b in enumerate(BATCHES):
        batch = spark.createDataFrame(b, SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(source)
        store.maintain(spark.readStream.schema(SCHEMA).parquet(source), mark).awaitTermination()
        want.apply(batch, i)
    assert state(store) == state(want)


def test_a_build_that_fails_leaves_the_old_engine(spark, tmp_path, monkeypatch):
    records = [(1, "u1", "a|b|c|red shirt"), (2, "u2", "a|b|c|blue hat")]
    products = spark.createDataFrame(records, "doc_id long, url string, text string")
    Engine.build(spark, products, path=str(tmp_path))
    write, done = engine.write_table, []

    def failing(table, path):
        if len(done) == 3:
            raise RuntimeError("lost")
        done.append(path)
        write(table, path)

    monkeypatch.setattr(engine, "write_table", failing)
    with pytest.raises(RuntimeError):
        Engine.build(spark, products.where("doc_id = 2"), path=str(tmp_path))
    monkeypatch.setattr(engine, "write_table", write)
    old = Engine.read(spark, str(tmp_path))
    assert [r.doc_id for r in old.search_text("red shirt").collect()] == [1]
    Engine.build(spark, products.where("doc_id = 2"), path=str(tmp_path))
    assert Engine.read(spark, str(tmp_path)).descriptors.count() == 1
    assert [r.doc_id for r in old.search(tables.query_frame(spark, ["red shirt"])).collect()] == [1]  # whoever reads the old one still does
