"""Normalization of odd records, indicators, metrics, and streaming against batch."""

import json

from pyspark.sql import functions as F

from chainspark.operators import evaluate, indicators, normalize
from chainspark.operators.rules import stateless
from chainspark.sources.telemetry import telemetry
from chainspark.streaming import detections as streams


def normal(spark, *records):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return sorted(normalize.normalize(spark.createDataFrame(rows, "idx long, raw string")).collect(), key=lambda r: r.idx)


def test_aliases_and_types(spark):
    out = normal(
        spark,
        {"time": "2024-05-01T10:00:00Z", "EventID": 4625, "Computer": "WS1", "TargetUserName": "CORP\\Bob@x"},
        {"time": 1714557600, "type": "netflow", "src": " 1.2.3.4 ", "dport": "70000", "pid": -4},
        {"@timestamp": 1714557600000, "event_type": "T1059", "host": "h"},
        {"UtcTime": "13/05/2024 08:00:00", "QueryName": "a.b", "Image": "C:\\w\\dns.exe", "x y": "z"},
        {"event_id": "abc", "time": "1714557600", "event": "psexec", "hostname": "", "device": "d"},
        [],
        "not json",
        None,
    )
    assert [r.event_type for r in out] == ["LOGIN_ATTEMPT", "NETWORK_CONNECTION", None, "DNS_QUERY", "REMOTE_EXECUTION", None, None, None]
    assert (out[0].host, out[0].user, out[0].severity) == ("ws1", "bob", "LOW")
    assert out[0].sec == out[1].sec == out[2].sec == 1714557600
    assert (out[1].source_ip, out[1].destination_port, out[1].process_id) == ("1.2.3.4", None, None)
    assert {i.field for i in out[1].issues} == {"destination_port", "process_id"}
    assert (out[3].process_name, out[3].metadata, str(out[3].timestamp)) == ("dns.exe", {"x y": "z"}, "2024-05-13 08:00:00")
    assert (out[4].event_id, out[4].host, out[4].timestamp) == ("EVT-abc", "d", None)
    assert [i.scope for i in out[6].issues] == ["record"] and out[7].event_type is None


def test_indicators(spark):
    rows = [(0, None, "1.2.3.4", "a"), (1, "ip", "1.2.3.4", "b"), (2, "zzz", "Evil.COM", None), (3, None, "???", "a"), (4, None, "d" * 32, "a"), (5, None, "", "a")]
    listed = indicators.indicators(spark.createDataFrame(rows, "idx long, type string, value string, source string"))
    assert {(r.type, r.key, r.source) for r in listed.collect()} == {("ip", "1.2.3.4", "a"), ("ip", "1.2.3.4", "b"), ("domain", "evil.com", "import"), ("hash", "d" * 32, "a")}
    events = spark.createDataFrame([("e", "1.2.3.4", None, "EVIL.com"), ("f", None, "9.9.9.9", None)], "event_id string, source_ip string, destination_ip string, domain string")
    assert {(r.event_id, r.field, r.source) for r in indicators.match(events, listed).collect()} == {("e", "source_ip", "b"), ("e", "domain", "import")}


def test_confusion(spark):
    p = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "x")], "g string, i string")
    e = spark.createDataFrame([("s", "a"), ("s", "c"), ("u", "y")], "g string, i string")
    got = {r.g: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in evaluate.confusion(p, e, "g", "i").collect()}
    assert got == {"s": (1, 1, 1, 0.5, 0.5, 0.5), "t": (0, 1, 0, 0.0, None, None), "u": (0, 0, 1, None, 0.0, None)}


def _run(frame, mode, name, folder):
    run = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}").start()
    assert run.awaitTermination(180)
    return frame.sparkSession.table(name)


def test_streams_equal_batch(spark, tmp_path):
    events = telemetry(spark, "/root/testdata/sf0.001").repartition(1).sortWithinPartitions("sec").cache()
    for i in range(2):  # two files in order of time, read one a batch; the first again at the end
        events.where(f"cast(substring(event_id, 5) as int) between {500 * i} and {500 * i + 499}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = ["event_id", "rule_id", "severity", "technique_id", "title"]
    got = _run(streams.stream_detections(stream), "append", "found", tmp_path)
    assert sorted(got.select(key).collect()) == sorted(stateless(events).select(key).collect())
    got = _run(streams.stream_counts(stream), "complete", "counts", tmp_path)
    assert got.agg(F.sum("n")).first()[0] == stateless(events).count()
    twice = stream.union(stream)
    assert _run(streams.stream_distinct(twice), "append", "one_each", tmp_path).count() == events.count()
    listed = indicators.indicators(spark.createDataFrame([(0, "ip", "8.8.3.1", "a"), (1, None, "h0.update-cdn-live.net", "b")], "idx long, type string, value string, source string"))
    got = _run(streams.stream_matches(stream, listed), "append", "hits", tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, indicators.match(events, listed).collect()))
