"""The bucketed event store: what it reads, writes and keeps when a write fails."""

import pytest
from pyspark.sql import functions as F

from chainspark.sinks import event_store
from chainspark.sinks.event_store import EventStore, of_dataset

SCHEMA = "event_id string, idx long, v1 string, metadata map<string,string>"


def rows(spark, ids, value="a", dataset="d"):
    return spark.createDataFrame([(f"E{i}", k, value, {"dataset_id": dataset}) for k, i in enumerate(ids)], SCHEMA)


def held(store):
    return {r.event_id: r.v1 for r in store.read().collect()}


def test_ingests_meet_only_their_buckets(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 8)
    assert store.read() is None
    assert store.add(rows(spark, range(40))) == {"received": 40, "stored": 40, "duplicates": 0}
    assert store.add(rows(spark, [3, 3, 50], "b")) == {"received": 3, "stored": 1, "duplicates": 2}
    assert held(store)["E3"] == "a" and held(store)["E50"] == "b" and store.read().count() == 41
    folders = {v: sum(1 for _, x in store.live() if x == v) for v in (1, 2)}
    assert folders == {1: 8, 2: 1}
    assert store.add(rows(spark, [3, 60], "c"), replace_duplicates=True)["stored"] == 1
    assert held(store)["E3"] == "c" and store.read().count() == 42
    bucket = spark.range(1).select(F.lit("E3").alias("event_id")).select(store._bucket()).first()[0]
    assert [v for b, v in store.live() if b == bucket] == [3]
    files = store.read([bucket]).inputFiles()
    assert files and all(f"bucket={bucket}" in f for f in files)
    before = store.version()
    store.add(rows(spark, [3], "d"))
    assert store.version() == before


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "s"), 4)
    store.add(rows(spark, range(10)))
    want = held(store)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(EventStore, "_write_manifest", lost)
    with pytest.raises(RuntimeError):
        store.add(rows(spark, range(5, 20), "b"), replace_duplicates=True)
    monkeypatch.undo()
    assert held(store) == want
    store.add(rows(spark, range(5, 20), "b"), replace_duplicates=True)
    assert held(store) == {f"E{i}": "a" if i < 5 else "b" for i in range(20)}


def test_many_folders_are_joined_and_a_dataset_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_store, "FOLDERS", 2)
    store = EventStore(spark, str(tmp_path / "s"), 2)
    for k in range(5):
        store.add(rows(spark, range(10 * k, 10 * k + 10), "a", f"d{k}"))
    assert store.read().count() == 50 and max(sum(1 for x, _ in store.live() if x == b) for b in (0, 1)) <= 2
    assert store.remove(of_dataset("d3")) == 10 and store.remove(of_dataset("none")) == 0
    assert sorted(held(store)) == sorted(f"E{i}" for i in range(50) if not 30 <= i < 40)
    assert store.remove(F.lit(True)) == 40 and (store.read() is None or store.read().count() == 0)
