"""Linked, counted and tallied without all pairs, events give what all pairs give."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chainspark.config import DEFAULT
from chainspark.operators import blocking, chains, correlate
from chainspark.operators.components import components
from test_blocking import random_events


def seeded(spark, seed, n=120):
    """Some events with a tactic carry no technique."""
    events = random_events(spark, seed, n)
    return events.withColumn("technique_id", F.when(F.xxhash64("event_id") % 3 != 0, F.col("technique_id"))).localCheckpoint()


def parts(edges):
    return {tuple(r) for r in components(edges).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_links_connect_what_all_edges_connect(spark, seed, monkeypatch):
    rng = random.Random(seed)
    cfg = DEFAULT
    if seed:
        cfg = replace(DEFAULT, weights={s: rng.randrange(0, 25) for s in DEFAULT.weights}, min_edge_score=rng.randrange(25, 60), absorb_score=rng.randrange(30, 80))
    if correlate.time_alone(cfg) >= cfg.min_edge_score:
        cfg = replace(cfg, min_edge_score=correlate.time_alone(cfg) + 1)
    events = seeded(spark, seed + 10, 60 + 60 * (seed % 2))
    edges = correlate.edges_of(correlate.score_pairs(correlate.entity_pairs(events).unionByName(correlate.near_pairs(events, cfg)), cfg), cfg).localCheckpoint()
    for most in (0, 15):
        for strong in (False, True):
            pairs, sure = blocking.linked_pairs(correlate._keyed(events, ()), cfg, correlate._ordered("a", "b"), (), strong, most)
            scored = correlate.edges_of(correlate.score_pairs(pairs.unionByName(correlate.near_pairs(events, cfg)), cfg), cfg).where(correlate.is_strong(cfg) if strong else F.lit(True))
            want = parts(edges.where(correlate.is_strong(cfg)) if strong else edges)
            assert parts(scored.select("event_a", "event_b").unionByName(sure)) == want, (most, strong, cfg)


def test_a_process_of_many_events_is_linked_by_few_pairs(spark):
    n = F.col("id")
    nulls = [F.lit(None).cast("string").alias(c) for c in ("user", "source_ip", "destination_ip", "domain", "file_path", "command_line", "parent_process")]
    rows = spark.range(3000).select(F.format_string("E%05d", n).alias("event_id"), (n * 1000).alias("sec"), F.lit("PROCESS_CREATED").alias("event_type"), F.lit("h").alias("host"), F.lit("p.exe").alias("process_name"), F.lit("EXECUTION").alias("tactic"), F.lit("T1").alias("technique_id"), F.lit(1).alias("process_id"), F.lit(1).alias("parent_process_id"), *nulls)
    for strong in (False, True):
        found = correlate.links(rows, strong=strong).localCheckpoint()
        assert found.count() <= 4 * 3000
        assert components(found).select("component").distinct().count() == 1


def test_a_tally_gives_confidence_reasons_and_strongest_links_of_all_edges(spark):
    events = seeded(spark, 31, 150)
    edges = correlate.correlate(events).localCheckpoint()
    members = chains.chain_members(edges, events).localCheckpoint()
    internal = chains.internal_edges(edges, members).localCheckpoint()
    tallied = chains.tally(events, members).localCheckpoint()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(chains.confidence_of(tallied)) == rows(chains.confidence(internal)) and internal.count() > 100
    first = lambda df: rows(df.select("chain", "event_a", "event_b", "total").orderBy("chain", F.desc("total"), "event_a", "event_b").limit(6))
    strongest = chains.strongest_links(tallied, events, members, 6).localCheckpoint()
    for chain, in members.select("chain").distinct().collect():
        assert first(strongest.where(F.col("chain") == chain)) == first(internal.where(F.col("chain") == chain))
    said = {(r.chain, r.group): r for r in chains.confidence_reasons(tallied, events, members).collect()}
    for (chain, group), r in said.items():
        points = sum((F.col(s) for s in correlate.GROUPS[group][1:]), F.col(correlate.GROUPS[group][0]))
        best = internal.where((F.col("chain") == chain) & (points > 0)).orderBy(F.desc("total"), "event_a", "event_b").first()
        assert (best.event_a, best.event_b) == (r.event_a, r.event_b) and r.explanation
    assert said


def test_counted_candidates_are_those_of_all_pairs(spark):
    for seed in (1,):
        events = random_events(spark, seed).withColumn("host", F.when(F.col("host") != "", F.col("host"))).where("sec is not null").localCheckpoint()
        got = correlate.candidate_counts(events).first()
        made = correlate.ranked_candidates(events).localCheckpoint()
        assert tuple(got) == (made.count(), made.where("outside = 1").count(), correlate.entity_pairs(events).count(), correlate.lineage_pairs(events).count())
