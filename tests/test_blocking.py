"""Pairs made by the bound give the edges of all pairs."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from chainspark.config import DEFAULT
from chainspark.functions.substrings import contained
from chainspark.operators import blocking, correlate
from chainspark.sources.telemetry import telemetry

SCHEMA = "event_id string, sec long, event_type string, host string, user string, source_ip string, destination_ip string, domain string, file_path string, process_name string, process_id long, parent_process string, parent_process_id long, command_line string, tactic string, technique_id string"
KINDS = ["FILE_CREATED", "PROCESS_CREATED", "DNS_QUERY", "NETWORK_CONNECTION", "REGISTRY_MODIFIED", "LOGIN_SUCCESS", "REMOTE_EXECUTION"]
TACTICS = ["EXECUTION", "PERSISTENCE", "COMMAND AND CONTROL", "INITIAL ACCESS"]


def random_events(spark, seed, n=120):
    rng = random.Random(seed)
    names = ["a.exe", "Bad.exe", "cmd.exe", "x", "reg.exe"]
    maybe = lambda values, p=0.6: rng.choice(values) if rng.random() < p else None
    rows = []
    for i in range(n):
        command = " ".join(rng.choice([*names, "ev.il", "9.9.9.9", "--run", "c:\\t\\bad.exe"]) for _ in range(rng.randrange(0, 4))) or None
        rows.append((
            f"E{i:03}", maybe([rng.randrange(0, 3000), rng.randrange(0, 10**6)], 0.95), rng.choice(KINDS), maybe(["H1", "h2", "h1", ""], 0.8), maybe(["u1", "U1", "u2"]), maybe(["1.1.1.1", "2.2.2.2"]),
            maybe(["9.9.9.9", "8.8.8.8"]), maybe(["ev.il", "ok.net"]), maybe(["c:\\t\\Bad.exe", "d/x", "c:\\t\\a.exe"]), maybe(names), maybe([1, 2, 3]), maybe(names, 0.3), maybe([1, 2, 3]), command,
            tactic := maybe(TACTICS, 0.4), "T1" if tactic else None,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def edges(pairs, cfg):
    return {(r.event_a, r.event_b, r.total) for r in correlate.edges_of(correlate.score_pairs(pairs, cfg), cfg).collect()}


def bound(events, cfg, most):
    keyed = correlate._keyed(events, ())
    return blocking.bound_pairs(keyed, cfg, correlate._ordered("a", "b"), most=most).unionByName(correlate.near_pairs(events, cfg))


def all_pairs(events, cfg):
    return correlate.entity_pairs(events).unionByName(correlate.near_pairs(events, cfg))


def test_equal_edges_on_random_events_and_weights(spark):
    rng = random.Random(1)
    for seed in range(4):
        cfg = DEFAULT
        if seed:
            cfg = replace(DEFAULT, weights={s: rng.randrange(0, 25) for s in DEFAULT.weights}, min_edge_score=rng.randrange(20, 70), broad_seconds=rng.choice([600, 250]))
        if correlate.time_alone(cfg) >= cfg.min_edge_score:
            cfg = replace(cfg, min_edge_score=correlate.time_alone(cfg) + 1)
        events = random_events(spark, seed).cache()
        got = bound(events, cfg, (0, 25)[seed % 2])
        ids = [(r.a.event_id, r.b.event_id) for r in got.collect()]
        assert len(ids) == len(set(ids))
        want = edges(all_pairs(events, cfg), cfg)
        assert edges(got, cfg) == want and want, (seed, cfg)


def test_equal_edges_on_the_telemetry(spark):
    events = telemetry(spark, "/root/testdata/sf0.001").withColumns({"tactic": F.lit("EXECUTION"), "technique_id": F.lit("T1059")}).cache()
    want = edges(all_pairs(events, DEFAULT), DEFAULT)
    assert edges(correlate.candidates(events), DEFAULT) == edges(bound(events, DEFAULT, 20), DEFAULT) == want and len(want) > 100


def test_a_busy_host_makes_few_pairs(spark):
    """10,000 events of 1,000 accounts on one host over a year: the pairs made are a small part of the host's fifty million."""
    n = F.col("id")
    year = 365 * 86400
    rows = spark.range(10_000).select(
        F.format_string("E%05d", n).alias("event_id"), F.pmod(F.xxhash64(n), F.lit(year)).alias("sec"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (n % 7 + 1).cast("int")).alias("event_type"),
        F.lit("busy").alias("host"), F.lit(None).cast("string").alias("parent_process"), F.concat(F.lit("u"), n % 1000).alias("user"), F.format_string("10.0.%d.%d", n % 7, n % 251).alias("source_ip"), F.concat(F.lit("p"), n % 5000, F.lit(".exe")).alias("process_name"),
        n.alias("process_id"), (n - 1).alias("parent_process_id"), F.concat(F.lit("run file"), n % 3001, F.lit(".dat")).alias("command_line"), F.concat(F.lit("c:\\file"), n % 4001, F.lit(".dat")).alias("file_path"),
    )
    made = correlate.candidates(rows).count()
    assert made * 20 < 10_000 * 9_999 // 2, made


def test_minimal_sets():
    sets = blocking.far_sets(DEFAULT)
    assert not any(a < b for a in sets for b in sets)
    assert frozenset({"host", "lineage"}) in sets and frozenset({"host", "user", "acted"}) in sets
    assert frozenset({"host"}) not in sets and frozenset({"user"}) not in sets


def test_needles_in_texts(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(rng.randrange(0, n)))
    needles = [(rng.choice("xy"), word(9)) for _ in range(60)] + [(None, "a"), ("x", None)]
    texts = [(rng.choice("xyz"), word(40)) for _ in range(80)] + [("x", None)]
    got = {tuple(r) for r in contained(spark.createDataFrame(needles, "by string, needle string"), spark.createDataFrame(texts, "by string, text string")).collect()}
    assert got == {(b, n, t) for b, n in needles for c, t in texts if b == c and b and n and t and n in t}
