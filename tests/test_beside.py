"""Edges of a host scored by columns in small blocks are those of all pairs, one by one."""

import pytest
from pyspark.sql import functions as F

from chainspark.config import DEFAULT
from chainspark.operators import beside, chains, correlate, counted
from test_counted import weighed
from test_linking import seeded


@pytest.mark.parametrize("seed", range(2))
def test_kinds_parts_and_tallies_in_small_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(beside, "ROWS", 16)
    monkeypatch.setattr(beside, "STRETCH", 1 + seed)
    cfg = weighed(seed)
    events = seeded(spark, seed + 60, 150).withColumn("host", F.when(F.xxhash64("event_id") % 8 > 0, F.lit("one")).otherwise(F.col("host"))).localCheckpoint()
    edges = correlate.edges_of(correlate.score_pairs(correlate.entity_pairs(events).unionByName(correlate.near_pairs(events, cfg)), cfg), cfg).localCheckpoint()
    rows = lambda df: sorted(map(repr, df.collect()))
    want = edges.groupBy("window", *correlate.SIGNALS, "total").agg(F.count(F.lit(1)).alias("n"))
    got = chains.edge_kinds(events, cfg, most=0)
    assert rows(got.select(*want.columns)) == rows(want) and edges.where("window is not null").count() > 20
    listed = ("event_a", "event_b", "window", "total", *correlate.SIGNALS)
    for most in (3, 1000):
        monkeypatch.setattr(beside, "FAR_ROWS", most)
        assert rows(chains.every_edge(events, cfg, most=0).select(*listed)) == rows(edges.select(*listed))
    near = edges.where("window is not null and same_host > 0")
    ready = chains.prepared(events, cfg).localCheckpoint()
    assert beside.kinds(ready, cfg, (), correlate.SIGNALS).agg(F.sum("n")).first()[0] == near.count() or cfg.weights["same_host"] == 0
    for strong in (False, True):
        part = dict(beside.parts(ready, cfg, (), strong).groupBy("num").agg(F.min("root")).collect())
        linked = near.where(correlate.is_strong(cfg)) if strong else near
        assert len(part) == linked.select(F.explode(F.array("event_a", "event_b"))).distinct().count() or cfg.weights["same_host"] == 0
    members = events.select("event_id", F.lit("E").alias("chain")).localCheckpoint()
    want = chains.tally(events, members, cfg, most=10**6)
    assert rows(chains.tally(events, members, cfg, most=0, rows=lambda: ready).select(*want.columns)) == rows(want)


def test_pairs_over_stretches_and_blocks_are_met_once(spark, monkeypatch):
    """5,000 events of one host, one a minute: each account's pairs at most ten minutes apart, however stretches and blocks fall."""
    monkeypatch.setattr(beside, "ROWS", 300)
    n = F.col("id")
    none = F.lit(None).cast("string")
    events = spark.range(5000).select(F.format_string("E%05d", n).alias("event_id"), (n * 60).alias("sec"), F.lit("LOGIN_ATTEMPT").alias("event_type"), F.lit("h").alias("host"), F.format_string("u%d", n % 2).alias("user"), none.alias("technique_id"), none.alias("tactic"), none.alias("parent_process")).localCheckpoint()
    want = sum(1 for a in range(5000) for b in range(a + 2, min(a + 11, 5000), 2))
    ready = counted.prepared(correlate._keyed(events, ()), DEFAULT).localCheckpoint()
    assert beside.kinds(ready, DEFAULT, (), correlate.SIGNALS).agg(F.sum("n")).first()[0] == want
