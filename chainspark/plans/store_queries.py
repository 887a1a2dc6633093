"""Queries of the bucketed event store: ingests, replacement, removal of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.plans.oracle_parts import with_
from chainspark.plans.queries import query
from chainspark.plans.stored import Derived, derived
from chainspark.sinks.event_store import EventStore, of_dataset


def _rows(d: Derived) -> DataFrame:
    """Events with their number, a version, and one of seven datasets."""
    n = F.substring("event_id", 5, 12).cast("long").alias("idx")
    name = F.concat(F.lit("d-"), F.substring("event_id", 5, 12).cast("long") % 7)
    return d.telemetry.select("event_id", n, "host", "sec", F.lit(1).alias("version"), F.create_map(F.lit("dataset_id"), name).alias("metadata"))


def _filled(d: Derived, name: str) -> EventStore:
    """A store after three ingests: two thirds of the events, all of them (a third replaced), and the first ones again; then one dataset removed."""

    def write(path: str) -> None:
        rows, store = _rows(d), EventStore(d.spark, path, 16)
        store.add(rows.where("idx % 3 <> 0"))
        store.add(rows.where("idx % 3 <> 1").withColumn("version", F.lit(2)), replace_duplicates=True)
        store.add(rows.where("idx % 3 <> 2").withColumn("version", F.lit(3)))
        if name == "store_removed":
            store.remove(of_dataset("d-3"))

    return EventStore(d.spark, d.store.files(name, write), 16)


@query("event_store", with_("SELECT event_id, host, sec, if(substr(event_id, 5)::BIGINT % 3 = 1, 1, 2) AS version FROM p"))
def event_store(spark, sf_dir):
    """Of ids that come again the stored row stays, or gives way where replacement is asked for."""
    return _filled(derived(spark, sf_dir), "store_filled").read().select("event_id", "host", "sec", "version")


@query("event_store_removed", with_("SELECT event_id, 'd-' || substr(event_id, 5)::BIGINT % 7 AS dataset FROM p WHERE substr(event_id, 5)::BIGINT % 7 <> 3"))
def event_store_removed(spark, sf_dir):
    """The events that a dataset's removal leaves."""
    return _filled(derived(spark, sf_dir), "store_removed").read().select("event_id", F.element_at("metadata", "dataset_id").alias("dataset"))


@query("event_store_counts", with_("""SELECT 1 AS turn, count(*) AS received, count(*) AS stored, 0::BIGINT AS duplicates FROM p UNION ALL SELECT 2, 2 * count(*), 0, 2 * count(*) FROM p"""))
def event_store_counts(spark, sf_dir):
    """What an ingest reports: all events, then each of them twice."""
    d = derived(spark, sf_dir)

    def write(path: str) -> None:
        store, rows = EventStore(d.spark, f"{path}-events", 16), _rows(d)
        told = [store.add(rows), store.add(rows.unionByName(rows))]
        d.spark.createDataFrame([(i + 1, t["received"], t["stored"], t["duplicates"]) for i, t in enumerate(told)], "turn int, received long, stored long, duplicates long").write.mode("overwrite").parquet(path)

    return spark.read.parquet(d.store.files("store_counts", write))
