"""Rules, correlation and chains on hand-made events, and the registered queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from chainspark.functions.scalars import is_private_ip
from chainspark.operators import chains, correlate, entities, graph, rules
from chainspark.plans.stored import derived
from chainspark.sources.telemetry import COLUMNS

KINDS = {"sec": "long", "destination_port": "int", "process_id": "int", "parent_process_id": "int", "timestamp": "timestamp"}


def events(spark, *rows):
    schema = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in COLUMNS)
    return spark.createDataFrame([tuple({"event_id": f"E{i:03}", "severity": "INFO", **r}.get(c) for c in COLUMNS) for i, r in enumerate(rows)], schema)


def found(df):
    return {(r.event_id, r.rule_id, r.severity, r.technique_id) for r in rules.detect(df).collect()}


def test_brute_force_counts_since_the_last_success(spark):
    fail = {"event_type": "LOGIN_ATTEMPT", "user": "Ann", "source_ip": "1.2.3.4"}
    rows = [{**fail, "sec": 10 * i} for i in range(6)]
    rows += [{"event_type": "LOGIN_SUCCESS", "user": "ann", "source_ip": "1.2.3.4", "sec": 70}, {**fail, "sec": 80}, {"event_type": "LOGIN_SUCCESS", "user": "ann", "source_ip": "1.2.3.4", "sec": 90}]
    assert found(events(spark, *rows)) == {("E004", "AUTH_BRUTE_FORCE", "HIGH", "T1110.001"), ("E005", "AUTH_BRUTE_FORCE", "HIGH", "T1110.001"), ("E006", "AUTH_SUCCESS_AFTER_FAILURES", "CRITICAL", "T1078")}
    apart = [{**fail, "sec": 200 * i} for i in range(8)]
    assert found(events(spark, *apart)) == set()
    alone = {"event_type": "LOGIN_SUCCESS", "user": "bob", "source_ip": "1.2.3.4", "sec": 1}
    assert found(events(spark, alone)) == set()
    tied = [{**fail, "sec": 5} for _ in range(6)]
    assert {f[0] for f in found(events(spark, *tied))} == {"E004", "E005"}


def test_powershell_benign_and_not(spark):
    ps = {"event_type": "PROCESS_CREATED", "process_name": "powershell.exe", "host": "h", "sec": 1}
    got = found(events(spark, {**ps, "command_line": "Get-Service"}, {**ps, "command_line": "powershell -nop -w hidden iex x"}, {**ps, "command_line": "-EncodedCommand AAAA", "parent_process": "WINWORD.EXE"}, {**ps}))
    assert got == {
        ("E001", "SUSPICIOUS_POWERSHELL", "HIGH", "T1059.001"), ("E002", "OFFICE_SPAWNS_POWERSHELL", "HIGH", "T1059.001"),
        ("E002", "ENCODED_POWERSHELL", "HIGH", "T1027"), ("E002", "SUSPICIOUS_POWERSHELL", "HIGH", "T1059.001"),
    }


def test_private_addresses(spark):
    ips = {"10.1.2.3": True, "8.8.8.8": False, "172.20.0.1": True, "172.32.0.1": False, "x": True, "256.1.1.1": True, "239.1.1.1": True, "::1": True, "2606:4700::1": False, "fe80::1": True}
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r.ip: r.p for r in df.select("ip", is_private_ip(df.ip).alias("p")).collect()} == ips


def test_scores_and_chain(spark):
    rows = [
        {"event_type": "FILE_CREATED", "host": "H1", "user": "a", "file_path": "C:\\x\\Bad.exe", "sec": 0},
        {"event_type": "PROCESS_CREATED", "host": "h1", "user": "A", "process_name": "bad.exe", "process_id": 5, "sec": 20},
        {"event_type": "PROCESS_CREATED", "host": "h1", "process_name": "cmd.exe", "parent_process_id": 5, "command_line": "cmd lsass", "sec": 100},
        {"event_type": "DNS_QUERY", "host": "h2", "sec": 101},
    ]
    df = rules.enrich(events(spark, *rows), rules.detect(events(spark, *rows)))
    scores = {(r.event_a, r.event_b): r for r in correlate.score_pairs(correlate.candidates(df)).collect()}
    first = scores["E000", "E001"]
    assert (first.temporal, first.same_host, first.same_user, first.process_relationship, first.event_dependency, first.total) == (20, 20, 11, 20, 5, 76)
    assert scores["E001", "E002"].process_relationship == 20 and ("E000", "E003") not in scores
    members = chains.chain_members(correlate.correlate(df), df).collect()
    assert [(r.event_id, r.position) for r in sorted(members, key=lambda r: r.position)] == [("E001", 1), ("E002", 2)]


def test_entities_keep_the_first_role(spark):
    df = events(spark, {"event_type": "PROCESS_CREATED", "host": "h", "process_name": "A.exe", "parent_process": "a.exe", "source_ip": "1.1.1.1", "destination_ip": "1.1.1.1", "sec": 1})
    got = {(r.entity_type, r.value, r.role) for r in entities.event_entities(df).collect()}
    assert got == {("HOST", "h", "host"), ("IP", "1.1.1.1", "src"), ("PROCESS", "h:a.exe", "actor")}
    assert {r.relation for r in entities.relationships(df).collect()} == {"RUNS"}


def test_empty_events(spark):
    none = events(spark, {"event_type": "X"}).where("false")
    assert rules.detect(none).count() == 0 and correlate.correlate(rules.enrich(none, rules.detect(none))).count() == 0


@pytest.mark.parametrize("name", [
    "telemetry_events", "detections_all", "rules_probe", "detections_by_host", "edges", "edges_capped", "pairs_temporal", "chains", "chain_reasons", "missing_steps", "chain_evidence", "coverage",
    "normalize_odd", "chains_from_raw", "scan_json", "scan_csv", "adapter_otrf", "adapter_splunk", "catalog_load", "add_events", "ioc_feeds", "eval_scenarios", "eval_summary", "run_deltas",
    "graph_is_dag", "process_tree", "timeline", "chain_report", "chain_filter",
])
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in at)) for row in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_candidates_are_capped_before_scoring(spark):
    """Forty near but unrelated partners push out a far one that would score."""
    rows = [{"event_type": "PROCESS_CREATED", "host": "h", "user": "a", "process_name": "x.exe", "process_id": 7, "sec": 0}]
    rows += [{"event_type": "DNS_QUERY", "host": f"other-{i}", "sec": 5} for i in range(41)]
    rows += [{"event_type": "PROCESS_CREATED", "host": "h", "user": "a", "process_name": "x.exe", "process_id": 8, "sec": 10_000}]
    rows += [{"event_type": "DNS_QUERY", "host": f"more-{i}", "sec": 10_005} for i in range(41)]
    df = rules.enrich(events(spark, *rows), rules.detect(events(spark, *rows)))
    assert [(r.event_a, r.event_b) for r in correlate.correlate(df).collect()] == [("E000", "E042")]
    assert correlate.correlate_capped(df).count() == 0


def test_hot_keys_stay_exact(spark):
    """One host and one account in a third of the events: the join by key gives every pair once."""
    rows = [{"event_type": "PROCESS_CREATED", "host": "hot" if i % 3 == 0 else f"h{i}", "user": "system" if i % 3 == 0 else f"u{i % 7}", "process_name": f"p{i}.exe", "sec": 100 * i} for i in range(240)]
    df = events(spark, *rows)
    got = [(r.a.event_id, r.b.event_id) for r in correlate.entity_pairs(df).collect()]
    same = lambda x, y: x["host"] == y["host"] or x["user"] == y["user"]
    want = {(f"E{i:03}", f"E{j:03}") for i in range(240) for j in range(i + 1, 240) if same(rows[i], rows[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_details_explain_every_signal(spark):
    rows = [
        {"event_type": "FILE_CREATED", "host": "h", "user": "a", "file_path": "c:\\x\\bad.exe", "sec": 0},
        {"event_type": "PROCESS_CREATED", "host": "h", "user": "a", "process_name": "bad.exe", "sec": 20},
    ]
    df = rules.enrich(events(spark, *rows), rules.detect(events(spark, *rows)))
    said = {r.signal: r.detail for r in correlate.pair_details(correlate.score_pairs(correlate.candidates(df), keep=("a", "b"))).collect()}
    assert said["temporal"] == "20 s apart, strict" and said["same_host"] == "on host h" and said["event_dependency"] == "wrote and used bad.exe"
    one = correlate.reasons(correlate.correlate(df)).first()
    assert [r["group"] for r in one.reasons][:2] == ["temporal", "same_host"] and one.score == 76.0


def test_users_of_internal_edges_shuffle_only_sums(spark):
    """Confidence and the strongest links read the stored edges of chains; what is exchanged has been combined or cut by chain before."""
    d = derived(spark, "/root/testdata/sf0.001")
    plan = chains.confidence(d.internal)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "partial_avg" in plan
    links = chains.evidence(d.members, d.events, d.detections, d.internal, d.steps).where("type = 'CORRELATION_LINK'")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in links and "event_b" in links


def test_cycles_are_found(spark):
    members = spark.createDataFrame([("c", f"E{i}", i) for i in range(1, 4)] + [("d", "F1", 1), ("d", "F2", 2)], "chain string, event_id string, position int")
    line = [("c", "EVENT:E1", "EVENT:E2", "PRECEDES"), ("c", "EVENT:E2", "EVENT:E3", "PRECEDES"), ("d", "EVENT:F1", "EVENT:F2", "PRECEDES")]
    own = [("c", "PROCESS:h:p", "EVENT:E1", "EXECUTED"), ("c", "EVENT:E1", "PROCESS:h:q", "PARENT"), ("d", "EVENT:F1", "PROCESS:h:p", "PARENT"), ("d", "PROCESS:h:p", "EVENT:F2", "EXECUTED")]
    schema = "chain string, source string, target string, relation string"
    check = lambda extra: {r.chain: r.is_dag for r in graph.acyclic(spark.createDataFrame(line + own + extra, schema), members).collect()}
    assert check([]) == {"c": True, "d": True}
    assert check([("c", "PROCESS:h:q", "PROCESS:h:p", "SPAWNED")]) == {"c": False, "d": True}
    assert check([("d", "PROCESS:h:a", "PROCESS:h:b", "SPAWNED"), ("d", "PROCESS:h:b", "PROCESS:h:a", "SPAWNED")]) == {"c": True, "d": False}


def test_fan_out_over_hours_and_without_times(spark):
    rows = [{"event_type": "NETWORK_CONNECTION", "source_ip": "10.0.0.1", "destination_ip": f"8.8.8.{i % 10}", "sec": 1800 * i} for i in range(14)]
    rows += [{"event_type": "NETWORK_CONNECTION", "source_ip": "10.0.0.1", "destination_ip": "9.9.9.9"}]
    got = {r.event_id: r.title.split()[0] for r in rules.fan_out(events(spark, *rows)).collect()}
    assert got == {**{f"E{i:03}": str(min(i + 1, 10)) for i in range(7, 14)}, "E014": "11"}


def test_failures_across_hours(spark):
    """The window reaches over an hour's end; the success is long after its failures; many successes divide the counts."""
    key = {"user": "ann", "source_ip": "1.1.1.1"}
    rows = [{**key, "event_type": "LOGIN_ATTEMPT", "sec": 3500 + 40 * i} for i in range(6)]
    rows += [{**key, "event_type": "LOGIN_SUCCESS", "sec": 20_000}, {**key, "event_type": "LOGIN_ATTEMPT", "sec": 20_001}, {**key, "event_type": "LOGIN_SUCCESS", "sec": 20_002}]
    got = {r.event_id: r.title for r in rules.authentication(events(spark, *rows)).collect()}
    assert got == {"E004": "5 failed logins for 'ann' from 1.1.1.1", "E005": "6 failed logins for 'ann' from 1.1.1.1", "E006": "Successful login for 'ann' after 6 failures"}
