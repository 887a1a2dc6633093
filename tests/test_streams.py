"""Tables kept by micro-batches against those of one batch."""

import json
import random

from pyspark.sql import functions as F

from chainspark.operators import entities, normalize
from chainspark.operators.chains import chain_members
from chainspark.operators.correlate import correlate
from chainspark.operators.rules import authentication, detect, enrich, fan_out
from chainspark.sources import records
from chainspark.sources.telemetry import telemetry
from chainspark.streaming import chain_store, counting, raw
from chainspark.streaming import detections as streams


def dealt(spark, n=224, batches=6, seed=3):
    """Events of a few blocks in six batches without order: rows come late, and failures of one account are split over batches."""
    events = telemetry(spark, "/root/testdata/sf0.001").where(f"cast(substring(event_id, 5) as int) < {n}")
    deal = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(batches))
    return events.withColumn("deal", F.when(F.col("event_type").startswith("LOGIN"), deal).otherwise(F.floor(F.substring("event_id", 5, 12).cast("int") * batches / n)))


def test_chains_of_many_batches_equal_one(spark, tmp_path):
    rows = dealt(spark).cache()
    store = chain_store.ChainStore(spark, str(tmp_path / "chains"))
    for i in range(6):
        batch = rows.where(F.col("deal") == i).drop("deal")
        store.add(batch, i)
        if i == 4:
            store.add(batch, i)  # a batch repeated after a failure
    again = rows.where(F.col("deal") < 2).drop("deal")
    store.add(again, 6)  # events that are stored already change nothing
    events = rows.drop("deal")
    told = enrich(events, detect(events)).cache()
    got = store.current("events").select("event_id", "technique_id", "findings")
    assert sorted(map(str, got.collect())) == sorted(map(str, told.select("event_id", "technique_id", "findings").collect()))
    edges = correlate(told)
    key = ["event_a", "event_b", "total", "seed_a", "seed_b"]
    assert sorted(map(str, store.edges().select(key).collect())) == sorted(map(str, edges.select(key).collect()))
    want = chain_members(edges, told).select("chain", "event_id", "position")
    got = store.members().select("chain", "event_id", "position")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    written = {r.batch: r["count"] for r in spark.read.parquet(str(tmp_path / "chains/events")).groupBy("batch").count().collect()}
    assert 6 not in written and all(n < 120 for n in written.values())


def test_entities_by_batches(spark, tmp_path):
    rows = dealt(spark, batches=3).cache()
    merge = streams.merge_entities(str(tmp_path / "entities"))
    for i in (0, 1, 2, 2):
        merge(rows.where(F.col("deal") == i), i)
    columns = ["entity_type", "value", "first_seen", "last_seen", "events"]
    got = streams.read_entities(spark, str(tmp_path / "entities")).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, entities.entities(rows).select(columns).collect()))


def run(frame, name, folder):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}").start()
    assert query.awaitTermination(300)
    return frame.sparkSession.table(name)


def test_counting_rules_keep_state_over_batches(spark, tmp_path):
    counting.use_rocksdb(spark)
    events = telemetry(spark, "/root/testdata/sf0.001").where("cast(substring(event_id, 5) as int) < 640").cache()
    for i in range(4):  # every key's rows are dealt over all files, in order of time
        events.where(f"cast(substring(event_id, 5) as int) between {160 * i} and {160 * i + 159}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda rows: sorted((r.event_id, r.rule_id) for r in rows.collect())
    got = key(run(counting.stream_logons(stream()), "logons", tmp_path))
    assert got == key(authentication(events)) and got
    got = key(run(counting.stream_fan_out(stream()), "reached", tmp_path))
    assert got == key(fan_out(events)) and got
    # Stored events before the stream count as its initial state.
    half = events.where("cast(substring(event_id, 5) as int) < 320")
    events.where("cast(substring(event_id, 5) as int) >= 320").coalesce(1).write.parquet(str(tmp_path / "late"))
    late = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "late"))
    after = lambda rows: [r for r in key(rows) if int(r[0][4:]) >= 320]
    assert key(run(counting.stream_logons(late(), stored=half), "logons_late", tmp_path)) == after(authentication(events))
    assert key(run(counting.stream_fan_out(late(), stored=half), "reached_late", tmp_path)) == after(fan_out(events))


def test_raw_lines_after_a_failure_equal_a_scan(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rng = random.Random(2)
    kinds = [
        {"action": "failed_logon", "time": "2024-05-01T10:00:00Z", "host": "h1", "user": "u", "src_ip": "10.0.0.1"},
        {"EventID": 4688, "Computer": "H2", "Time": "2024-05-01 10:00:05", "Image": "c:\\w\\cmd.exe", "CommandLine": "cmd /c whoami"},
        {"type": "netflow", "src": "10.0.0.2", "dst": "8.8.8.8", "dport": 99999, "time": 1714557600},
    ]
    for k in range(4):
        lines = [json.dumps(rng.choice(kinds)) for _ in range(30)] + ["no json", "{}", ""]
        rng.shuffle(lines)
        (folder / f"f{k}.jsonl").write_text("\n".join(lines) + "\n")
    failed = []

    def fail_once(events, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    def start():
        lines = raw.read_lines(spark, str(folder), files_a_batch=1)
        return lines.writeStream.foreachBatch(raw.ingest(out, fail_once)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()

    try:
        start().awaitTermination(200)
    except Exception:
        assert failed == [2]
    assert start().awaitTermination(200)
    found, bad = records.scan_json_lines(spark, str(folder))
    events = normalize.normalize(found)
    typed = events.where("event_type is not null")
    got = raw.read_events(spark, out)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in typed.collect()) and got.count() == 120
    key = ["event_id", "rule_id", "severity", "title"]
    assert sorted(detect(got).select(key).collect()) == sorted(detect(typed).select(key).collect()) and detect(got).count() > 0
    issues = raw.read_issues(spark, out)
    want = normalize.issue_rows(events).select("field", "message").unionAll(bad.select(F.lit("record"), "message"))
    assert sorted(map(tuple, issues.select("field", "message").collect())) == sorted(map(tuple, want.collect()))
    assert issues.select("file", "line").distinct().count() == issues.where("scope = 'record' or field = 'destination_port'").select("file", "line").distinct().count()
