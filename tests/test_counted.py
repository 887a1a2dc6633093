"""Chains linked and tallied without the pairs of a process give what all pairs give."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chainspark.config import DEFAULT
from chainspark.operators import chains, correlate, counted
from chainspark.operators.components import components
from test_linking import seeded


def weighed(seed):
    rng = random.Random(seed)
    cfg = DEFAULT
    if seed:
        cfg = replace(DEFAULT, weights={s: rng.randrange(0, 25) for s in DEFAULT.weights}, min_edge_score=rng.randrange(25, 60), absorb_score=rng.randrange(30, 80))
    least = 1 + max(correlate.time_alone(cfg), cfg.weights["same_host"] + cfg.weights["attack_progression"])
    return replace(cfg, min_edge_score=max(cfg.min_edge_score, least))


@pytest.mark.parametrize("seed", range(2))
def test_parts_and_tallies_are_those_of_all_edges(spark, seed):
    cfg = weighed(seed)
    events = seeded(spark, seed + 40, 150)
    edges = correlate.edges_of(correlate.score_pairs(correlate.entity_pairs(events).unionByName(correlate.near_pairs(events, cfg)), cfg), cfg).localCheckpoint()
    rows = lambda df: sorted(map(repr, df.collect()))
    for strong in (False, True):
        want = components(edges.where(correlate.is_strong(cfg)) if strong else edges)
        assert rows(chains.clusters(events, cfg, strong=strong, most=0)) == rows(want), (strong, cfg)
    # One chain of all events has every edge inside it.
    members = events.select("event_id", F.lit("E").alias("chain")).localCheckpoint()
    want = chains.tally(events, members, cfg, most=10**6)
    got = chains.tally(events, members, cfg, most=0)
    assert rows(got.select(*want.columns)) == rows(want) and edges.count() > 20


def test_plain_pairs_of_a_process_are_not_made(spark):
    """3,000 events of one process over a month: their four and a half million edges are counted, none is made."""
    n = F.col("id")
    nulls = [F.lit(None).cast("string").alias(c) for c in ("user", "source_ip", "destination_ip", "domain", "file_path", "command_line", "parent_process")]
    rows = spark.range(3000).select(
        F.format_string("E%05d", n).alias("event_id"), (n * 1000).alias("sec"), F.lit("PROCESS_CREATED").alias("event_type"), F.lit("h").alias("host"), F.lit("p.exe").alias("process_name"),
        F.lit("EXECUTION").alias("tactic"), F.lit("T1").alias("technique_id"), F.lit(None).cast("int").alias("process_id"), F.lit(None).cast("int").alias("parent_process_id"), *nulls,
    ).localCheckpoint()
    keyed = correlate._keyed(rows, ())
    assert counted.near(keyed, DEFAULT).count() == 0
    told = counted.widely_held(keyed.withColumn("holds", F.array().cast("array<string>")), DEFAULT)
    assert counted.far(told, counted.special_sets(DEFAULT), DEFAULT).count() == 0
    members = rows.select("event_id", F.lit("E").alias("chain"))
    found = chains.tally(rows, members)
    assert found.agg(F.sum("links"), F.max("best")).first()[:] == (3000 * 2999 // 2, 50)
