"""Queries of scans, adapters, normalization, sinks and filters: telemetry written in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.operators import chains as C
from chainspark.operators import correlate as K
from chainspark.operators import filters, rules, views
from chainspark.operators import normalize as N
from chainspark.plans.oracle_parts import CHAINS, CORRELATE, DETECT, EVIDENCE, P, with_
from chainspark.plans.queries import query
from chainspark.plans.stored import Derived, derived
from chainspark.sinks import tables
from chainspark.sources import adapters, csv_files, records

_CARRIED = (
    "timestamp", "event_type", "host", "user", "source_ip", "destination_ip", "destination_port", "protocol", "process_name", "process_id",
    "parent_process", "parent_process_id", "command_line", "file_path", "domain",
)
# Names that two kinds of sensors give the canonical fields.
_STYLES = (
    {c: c for c in _CARRIED},
    {
        "timestamp": "UtcTime", "event_type": "EventType", "host": "Computer", "user": "SubjectUserName", "source_ip": "SourceIp", "destination_ip": "DestinationIp",
        "destination_port": "DestinationPort", "protocol": "Proto", "process_name": "Image", "process_id": "ProcessId", "parent_process": "ParentImage",
        "parent_process_id": "ParentProcessId", "command_line": "CommandLine", "file_path": "TargetFilename", "domain": "QueryName",
    },
)
_ROUND = (
    "event_id", "sec", "event_type", "host", "user", "source_ip", "destination_ip", "destination_port", "protocol", "process_name", "process_id",
    "parent_process", "parent_process_id", "command_line", "file_path", "domain", "severity",
)


def _number() -> Column:
    return F.substring("event_id", 5, 12).cast("long")


def raw_records(d: Derived) -> DataFrame:
    """The telemetry as JSON records of two sensors, every other one with a drive path, a domain user and an epoch."""
    rows = d.telemetry.withColumn("n", _number())
    made = []
    for style in _STYLES:
        second = style["host"] == "Computer"
        value = {
            "timestamp": F.col("sec") * 1000 if second else F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "user": F.concat(F.lit("CORP\\"), F.upper("user")) if second else F.col("user"),
            "process_name": F.concat(F.lit("C:\\Windows\\"), F.col("process_name")) if second else F.col("process_name"),
        }
        cells = [value.get(c, F.col(c)).alias(n) for c, n in style.items()]
        # What rules search stands in an object here, and in a field of its own there.
        note = F.col("note").alias("Details") if second else F.struct(F.col("note").alias("detail")).alias("metadata")
        made.append(F.to_json(F.struct(F.substring("event_id", 5, 12).alias("record_id"), *cells, F.lit("kept").alias("Extra Field"), note, F.col("event_id").alias("gt_id"))))
    return rows.select(F.col("n").alias("idx"), F.when(F.col("n") % 2 == 0, made[0]).otherwise(made[1]).alias("raw"))


_FIELDS = ", ".join(f'"{c}"' for c in _ROUND)


@query("normalize_events", with_(f"SELECT {_FIELDS}, 'kept' AS extra, note AS detail, event_id AS gt_id, 0 AS n_issues FROM p"))
def normalize_events(spark, sf_dir):
    out = N.normalize(raw_records(derived(spark, sf_dir)))
    detail = F.coalesce(F.element_at("metadata", "detail"), F.element_at("metadata", "Details"))
    return out.select(*_ROUND, F.element_at("metadata", "Extra Field").alias("extra"), detail.alias("detail"), "gt_id", F.size("issues").alias("n_issues"))


def odd_records(d: Derived) -> DataFrame:
    """Records of ten odd kinds, by the number of the event they are made from."""
    n = _number()
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    kinds = [
        F.lit('"a bare string"'),
        F.lit("{}"),
        F.concat(F.lit('{"event_type": "T1059.001", "host": '), text(n), F.lit(', "time": 1704067200}')),
        F.concat(F.lit('{"type": "netflow", "src": "1.2.3.4", "dport": "70000", "pid": -4, "time": 1704067200, "n": '), n, F.lit("}")),
        F.concat(F.lit('{"src": "5.5.5.5", "client_ip": "6.6.6.6", "EventID": "4625", "@timestamp": "2024-01-01 00:00:00", "user": "x\\\\y@z", "n": '), n, F.lit("}")),
        F.concat(F.lit('{"QueryName": "A.b", "utc_time": "13/01/2024 08:00:00", "n": '), n, F.lit("}")),
        F.concat(F.lit('{"metadata": "plain words", "event": "psexec", "hostname": "", "device": "D1", "time": "1704067200", "n": '), n, F.lit("}")),
        F.concat(F.lit('{"metadata": {"a": 1, "n": 2}, "EventID": 1, "Computer": "H", "time": 1704067200000, "n": '), n, F.lit("}")),
        F.concat(F.lit('{"event": "logon_success", "technique": "X99", "dst": "'), F.repeat(F.lit("9"), 70), F.lit('", "Time": "2024/01/01 00:00:10", "n": '), n, F.lit("}")),
        F.concat(F.lit('{"kind": "nothing known", "host": "h", "n": '), n, F.lit("}")),
    ]
    raw = kinds[-1]
    for k, v in enumerate(kinds[:-1]):
        raw = F.when(n % 10 == k, v).otherwise(raw)
    return d.telemetry.select(n.alias("idx"), raw.alias("raw"))


@query("normalize_odd", with_("""SELECT n AS idx, [NULL, NULL, NULL, 'NETWORK_CONNECTION', 'LOGIN_ATTEMPT', 'DNS_QUERY', 'REMOTE_EXECUTION', 'PROCESS_CREATED', 'LOGIN_SUCCESS', NULL][k + 1] AS event_type,
  CAST([NULL, NULL, 1704067200, 1704067200, 1704067200, 1705132800, NULL, 1704067200, 1704067210, NULL][k + 1] AS BIGINT) AS sec, CASE k WHEN 2 THEN n::VARCHAR WHEN 6 THEN 'd1' WHEN 7 THEN 'h' WHEN 9 THEN 'h' END AS host,
  CASE k WHEN 3 THEN '1.2.3.4' WHEN 4 THEN '5.5.5.5' END AS source_ip, CASE k WHEN 4 THEN 'y' END AS "user", CASE k WHEN 5 THEN 'a.b' END AS domain, CASE k WHEN 8 THEN 64 END AS cut,
  CASE WHEN k = 0 OR k = 1 THEN NULL WHEN k = 6 THEN 'plain words ' || n WHEN k = 7 THEN '1 1 ' || n WHEN k = 4 THEN '4625 ' || n WHEN k = 2 THEN '' ELSE n::VARCHAR END AS note,
  ['record', 'record', 'event_type', 'destination_port,process_id', '', 'identity', 'timestamp', '', 'destination_ip,technique_id', 'event_type,timestamp'][k + 1] AS fields
  FROM (SELECT event_id AS n, event_id % 10 AS k FROM events)"""))  # fmt: skip
def normalize_odd(spark, sf_dir):
    out = N.normalize(odd_records(derived(spark, sf_dir)))
    fields = F.array_join(F.array_sort(F.transform("issues", lambda i: i["field"])), ",").alias("fields")
    return out.select("idx", "event_type", "sec", "host", "source_ip", "user", "domain", F.length("destination_ip").alias("cut"), "note", fields)


def _odd_issues(d: Derived) -> DataFrame:
    """Issues of the odd records, listed once: a page of them and their number are two readings."""
    return d.store.table("odd_issues", lambda: N.issue_rows(N.normalize(odd_records(d))))


@query("normalize_issues", with_("""SELECT scope, field, count(*) AS n FROM (SELECT event_id % 10 AS k FROM events) JOIN (VALUES (0, 'record', 'record'), (1, 'record', 'record'), (2, 'record', 'event_type'), (3, 'field', 'destination_port'),
  (3, 'field', 'process_id'), (5, 'field', 'identity'), (6, 'field', 'timestamp'), (8, 'field', 'destination_ip'), (8, 'field', 'technique_id'), (9, 'record', 'event_type'), (9, 'field', 'timestamp')) v(k, scope, field) USING (k) GROUP BY ALL"""))  # fmt: skip
def normalize_issues(spark, sf_dir):
    return _odd_issues(derived(spark, sf_dir)).groupBy("scope", "field").agg(F.count(F.lit(1)).alias("n"))


@query("first_issues", with_("""SELECT n AS idx, field FROM (SELECT event_id AS n, event_id % 10 AS k FROM events) JOIN (VALUES (0, 'record'), (1, 'record'), (2, 'event_type'), (3, 'destination_port'), (3, 'process_id'), (5, 'identity'), (6, 'timestamp'),
  (8, 'destination_ip'), (8, 'technique_id'), (9, 'event_type'), (9, 'timestamp')) v(k, field) USING (k) ORDER BY n, field LIMIT 100"""))  # fmt: skip
def first_issues(spark, sf_dir):
    """The first hundred issues of an ingest (the feature)."""
    return filters.page(_odd_issues(derived(spark, sf_dir)).select("idx", "field"), [F.asc("idx"), F.asc("field")], 100, 0).select("idx", "field")


@query("ingest_report", with_("""SELECT 2 * count(*) AS received, count(*) + count(*) FILTER (WHERE n % 10 NOT IN (0, 1, 2, 9)) AS stored, 0::BIGINT AS duplicates, count(*) FILTER (WHERE n % 10 IN (0, 1, 2, 9)) AS skipped,
  sum([1, 1, 1, 2, 0, 1, 1, 0, 2, 2][n % 10 + 1])::BIGINT AS issue_count, (SELECT count(*) FROM det) AS detections FROM (SELECT event_id AS n FROM events)""", DETECT))  # fmt: skip
def ingest_report(spark, sf_dir):
    """The report of a batch of sound and odd records together; detections are those of the sound ones."""
    d = derived(spark, sf_dir)
    # Stored once: the rules' filters would otherwise be pushed into the normalization and make its fields anew for each.
    sound = d.store.table("raw_normalized", lambda: N.normalize(raw_records(d)))
    return N.ingest_report(sound.unionByName(N.normalize(odd_records(d))), rules.detect(sound))


@query("batch_cap", with_("SELECT least(count(*), 5000) AS taken, if(count(*) > 5000, 1, 0)::BIGINT AS issues FROM events"))
def batch_cap(spark, sf_dir):
    kept, over = N.capped_batch(raw_records(derived(spark, sf_dir)), 5000)
    return kept.agg(F.count(F.lit(1)).alias("taken"), F.lit(None).alias("x")).select("taken", over.agg(F.count(F.lit(1))).scalar().alias("issues"))


@query("chains_from_raw", with_("SELECT chain, event_id, sec, position FROM members", DETECT, CORRELATE, CHAINS, recursive=True))
def chains_from_raw(spark, sf_dir):
    """From JSON records to chains: normalize, detect, enrich, correlate."""
    d = derived(spark, sf_dir)
    events = d.store.table("raw_events", lambda: N.normalize(raw_records(d)).where("event_type is not null").drop("issues", "metadata"))
    found = d.store.table("raw_detections", lambda: rules.detect(events))
    told = d.store.table("raw_enriched", lambda: rules.enrich(events, found))
    return C.linked_members(told).select("chain", "event_id", "sec", "position")


# ------------------------------------------------------------------ scans


def _arrays(d: Derived) -> str:
    return d.store.files("json_arrays", lambda path: tables.export_json(raw_records(d), path, 500))


@query("scan_json", with_(f"SELECT {_FIELDS} FROM p"))
def scan_json(spark, sf_dir):
    """Written as files of JSON arrays, scanned whole, normalized."""
    found, _ = records.scan_json(spark, _arrays(derived(spark, sf_dir)))
    return N.normalize(found).select(*_ROUND)


@query("scan_json_shapes", with_("""SELECT ['list', 'events', 'single', 'bare', 'broken', 'number'][k + 1] AS shape, [2, 3, 1, 0, 0, 0][k + 1] * count(*) AS records, [0, 0, 0, 1, 1, 1][k + 1] * count(*) AS issues FROM (SELECT event_id % 6 AS k FROM events) GROUP BY k"""))
def scan_json_shapes(spark, sf_dir):
    """Texts of six shapes, one an event: what each gives in records and issues."""
    n = _number()
    shapes = ["list", "events", "single", "bare", "broken", "number"]
    texts = ['[{"a": 1}, {"a": 2}]', '﻿{"x": 1, "logs": [1, {"b": 2}, "c"], "data": 5}', '{"EventID": 5}', '{"a": [1]}', '{"a": ', "17"]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 6 + 1).cast("int"))
    rows = derived(spark, sf_dir).telemetry.select(F.concat_ws("-", pick(shapes), "event_id").alias("file"), pick(texts).alias("value"))
    found, issues = records.parse_json_texts(rows)
    shape = F.substring_index("file", "-", 1).alias("shape")
    both = found.select(shape, F.lit(1).alias("r"), F.lit(0).alias("i")).unionByName(issues.select(shape, F.lit(0).alias("r"), F.lit(1).alias("i")))
    return both.groupBy("shape").agg(F.sum("r").alias("records"), F.sum("i").alias("issues"))


@query("scan_json_lines", with_(f"SELECT {_FIELDS} FROM p"))
def scan_json_lines(spark, sf_dir):
    d = derived(spark, sf_dir)
    path = d.store.files("json_lines", lambda p: raw_records(d).select(F.col("raw").alias("value")).write.mode("overwrite").text(p))
    found, _ = records.scan_json_lines(spark, path)
    return N.normalize(found).select(*_ROUND)


@query("scan_csv", with_(f"SELECT {_FIELDS} FROM p"))
def scan_csv(spark, sf_dir):
    """Written as CSV with a union of keys for a header, the separator sniffed, scanned, normalized."""
    d = derived(spark, sf_dir)

    def write(path: str) -> None:
        tables.export_csv(raw_records(d), path)

    found, _ = csv_files.scan_csv(spark, d.store.files("csv", write))
    # In text every value is text, so the epochs of the second sensor are told by their name.
    epoch = F.regexp_replace("raw", '"UtcTime":"(\\d+)"', '"UtcTime":$1')
    return N.normalize(found.withColumn("raw", epoch)).select(*_ROUND)


# --------------------------------------------------------------- adapters

_IDS = {"LOGIN_ATTEMPT": "4625", "LOGIN_SUCCESS": "4624", "PROCESS_CREATED": "4688", "NETWORK_CONNECTION": "5156", "DNS_QUERY": "22", "FILE_CREATED": "11", "REGISTRY_MODIFIED": "13", "SERVICE_CREATED": "7045", "PRIVILEGE_CHANGE": "4672"}
_WINDOWS = f"event_type IN ({', '.join(repr(x) for x in _IDS)})"


def _event_ids() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in _IDS.items() for x in pair]), F.col("event_type"))


def _otrf_rows(d: Derived) -> DataFrame:
    """Windows events by their published field names; processes only in the message; some rows are bad."""
    n = _number()
    message = F.concat(F.lit("A process was created.\r\n\tNew Process ID:\t\t0x"), F.lower(F.hex("process_id")), F.lit("\r\n\tNew Process Name:\t"), F.coalesce("process_name", F.lit("-")), F.lit("\r\n\tProcess Command Line: "), F.coalesce("command_line", F.lit("-")))
    started = F.col("event_type") == "PROCESS_CREATED"
    raw = F.to_json(
        F.struct(
            _event_ids().alias("EventID"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("TimeCreated"), F.coalesce("host", F.lit("-")).alias("Hostname"), F.coalesce("source_ip", F.lit("N/A")).alias("SourceAddress"),
            F.col("destination_ip").alias("DestAddress"), F.col("destination_port").cast("string").alias("DestPort"), F.when(F.col("protocol") == "tcp", "6").alias("Protocol"), F.col("domain").alias("QueryName"),
            F.col("user").alias("TargetUserName"), F.when(~started, F.col("process_name")).alias("Application"), F.when(started, message).alias("Message"), F.lit("Security").alias("Channel"),
        )
    )
    bad = F.when(n % 97 == 1, '"a bare string"').when(n % 97 == 2, '{"random":"junk"}')
    return d.telemetry.where(_event_ids().isNotNull()).select(n.alias("idx"), F.coalesce(bad, raw).alias("raw"))


_BAD = "n % 97 NOT IN (1, 2)"


@query("adapter_otrf", with_(f"""SELECT sec, event_type, host, "user", source_ip, destination_ip, destination_port, if(event_type = 'NETWORK_CONNECTION', 'tcp', NULL) AS protocol, process_name,
  if(event_type = 'PROCESS_CREATED', process_id, NULL) AS process_id, if(event_type = 'PROCESS_CREATED', command_line, NULL) AS command_line, domain, 'security' AS channel, 'windows sample' AS label
  FROM (SELECT *, substr(event_id, 5)::BIGINT AS n FROM p) WHERE {_WINDOWS} AND {_BAD}"""))  # fmt: skip
def adapter_otrf(spark, sf_dir):
    d = derived(spark, sf_dir)
    path = d.store.files("otrf", lambda p: tables.export_json(_otrf_rows(d), p, 500))
    entry = {"id": "w-1", "adapter": "otrf_json", "label": "windows sample", "kind": "real", "path": path}
    found, _ = adapters.load_dataset(spark, entry)
    out = N.normalize(found)
    meta = lambda k: F.lower(F.element_at("metadata", F.lit(k)))
    return out.select("sec", "event_type", "host", "user", "source_ip", "destination_ip", "destination_port", "protocol", "process_name", "process_id", "command_line", "domain", meta("channel").alias("channel"), meta("dataset_label").alias("label"))


@query("adapter_issues", with_(f"""SELECT if(n % 97 = 1, 'row is no object', 'row has no time, host or event id') AS message, count(*) AS n FROM (SELECT substr(event_id, 5)::BIGINT AS n, event_type FROM p) WHERE {_WINDOWS} AND NOT {_BAD} GROUP BY ALL"""))
def adapter_issues(spark, sf_dir):
    d = derived(spark, sf_dir)
    path = d.store.files("otrf", lambda p: tables.export_json(_otrf_rows(d), p, 500))
    return adapters.load_otrf(spark, path)[1].groupBy("message").agg(F.count(F.lit(1)).alias("n"))


#: The view as that dataset carries it: Windows events that are not bad, command and process number of started processes only, no parents and files.
_AS_READ = P.replace("\np AS MATERIALIZED", "\nwhole AS MATERIALIZED") + f""",
p AS MATERIALIZED (SELECT * EXCLUDE (m) REPLACE (NULL::VARCHAR AS parent_process, NULL::INT AS parent_process_id, NULL::VARCHAR AS file_path, NULL::VARCHAR AS note, NULL::VARCHAR AS scenario_id,
  if(event_type = 'NETWORK_CONNECTION', 'tcp', NULL) AS protocol, if(event_type = 'PROCESS_CREATED', process_id, NULL) AS process_id, if(event_type = 'PROCESS_CREATED', command_line, NULL) AS command_line)
  FROM (SELECT *, substr(event_id, 5)::BIGINT AS m FROM whole) WHERE {_WINDOWS} AND m % 97 NOT IN (1, 2))"""


@query("dataset_run", with_(f"""SELECT 'rows_read' AS name, count(*) AS n FROM whole WHERE {_WINDOWS} UNION ALL SELECT 'issues', count(*) FROM whole WHERE {_WINDOWS} AND substr(event_id, 5)::BIGINT % 97 IN (1, 2)
  UNION ALL SELECT 'stored', count(*) FROM p UNION ALL SELECT 'skipped', 0 UNION ALL SELECT 'detections', count(*) FROM det UNION ALL SELECT 'chains', count(*) FROM ch
  UNION ALL SELECT 'attack_chains', count(*) FILTER (WHERE is_attack) FROM ch""", DETECT, CORRELATE, CHAINS, recursive=True, p=_AS_READ))  # fmt: skip
def dataset_run(spark, sf_dir):
    """Counts of a dataset run from its files to its chains."""
    d = derived(spark, sf_dir)
    path = d.store.files("otrf", lambda p: tables.export_json(_otrf_rows(d), p, 500))
    records, issues = adapters.load_otrf(spark, path)
    table = lambda name, make: d.store.table(f"otrf_{name}", make)
    events = table("events", lambda: N.normalize(records))
    typed = events.where("event_type is not null")
    found = table("detections", lambda: rules.detect(typed))
    full = table("enriched", lambda: rules.enrich(typed, found))
    ready = lambda: table("prepared", lambda: C.prepared(full))
    members = table("members", lambda: C.linked_members(full, rows=ready))
    chains = table("chains", lambda: C.verdicts(C.roll_up(members, full, found), C.confidence_of(C.tally(full, members, rows=ready))))
    return views.run_counts(records, issues, events, found, chains)


def _evtx_rows(d: Derived) -> DataFrame:
    n = _number()
    cells = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("SystemTime"), F.col("host").alias("Computer"), _event_ids().alias("EventID"), F.coalesce("source_ip", F.lit("-")).alias("IpAddress"),
        F.col("user").alias("TargetUserName"), F.when(n % 2 == 0, F.col("process_name")).alias("ProcessName"), F.when(n % 2 == 1, F.col("process_name")).alias("Application"), F.col("command_line").alias("CommandLine"),
        F.when(F.col("event_type") == "SERVICE_CREATED", "persistence").alias("EVTX_Tactic"), F.concat(F.lit("file-"), (n % 11).cast("string")).alias("EVTX_FileName"), F.col("destination_ip").alias("DestAddress"),
    )
    return d.telemetry.where(_event_ids().isNotNull()).select(n.alias("idx"), cells.alias("c"))


@query("adapter_evtx", with_(f"""SELECT sec, event_type, host, "user", source_ip, destination_ip, process_name, command_line, if(event_type = 'SERVICE_CREATED', 'PERSISTENCE', NULL) AS tactic, 'file-' || n % 11 AS evtx_file
  FROM (SELECT *, substr(event_id, 5)::BIGINT AS n FROM p) WHERE {_WINDOWS}"""))  # fmt: skip
def adapter_evtx(spark, sf_dir):
    d = derived(spark, sf_dir)
    path = d.store.files("evtx", lambda p: tables.export_json(_evtx_rows(d).select("idx", F.to_json("c").alias("raw")), p, 500))
    out = N.normalize(adapters.load_evtx(spark, path)[0])
    return out.select("sec", "event_type", "host", "user", "source_ip", "destination_ip", "process_name", "command_line", "tactic", F.element_at("metadata", "evtx_file").alias("evtx_file"))


@query("evtx_sample", with_(f"""SELECT n AS idx, file FROM (SELECT n, file, row_number() OVER (PARTITION BY file ORDER BY n) AS r FROM (SELECT *, substr(event_id, 5)::BIGINT AS n, 'file-' || substr(event_id, 5)::BIGINT % 11 AS file FROM p)
  WHERE {_WINDOWS} AND (command_line IS NOT NULL OR (n % 2 = 0 AND process_name IS NOT NULL) OR source_ip IS NOT NULL OR destination_ip IS NOT NULL OR event_type IN ('FILE_CREATED', 'REGISTRY_MODIFIED', 'SERVICE_CREATED')))
  WHERE r <= 60 ORDER BY n LIMIT 400"""))  # fmt: skip
def evtx_sample(spark, sf_dir):
    rows = _evtx_rows(derived(spark, sf_dir)).select("idx", "c.*")
    return adapters.evtx_sample(rows).select("idx", F.col("EVTX_FileName").alias("file"))


def _write_blocks(d: Derived, path: str) -> None:
    """Blocks of a time line, fields, and a message over several lines; 200 blocks a file."""
    n = _number()
    stamp = F.date_format("timestamp", "MM/dd/yyyy hh:mm:ss a")
    fields = F.concat(F.lit("LogName=Security\nEventCode="), _event_ids(), F.lit("\nComputerName="), F.coalesce("host", F.lit("-")), F.lit("\nMessage=First words.\n"))
    more = F.concat(F.lit("\t Account Name:\t\t"), F.col("user"), F.lit("\n\n    Image Name: "), F.coalesce("process_name", F.lit("-")), F.lit("\n    Source Address: "), F.coalesce("source_ip", F.lit("none")))
    block = F.concat_ws("\n", stamp, F.concat(fields, more))
    rows = d.telemetry.where(_event_ids().isNotNull()).select(F.floor(n / 200).alias("part"), n.alias("n"), block.alias("b"))
    texts = rows.groupBy("part").agg(F.concat(F.lit("garbage before\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n")).alias("value"))
    tables.write_texts(texts, path)


@query("adapter_splunk", with_(f"""SELECT sec, event_type, host, "user", source_ip, process_name, 'security' AS log FROM p WHERE {_WINDOWS}"""))
def adapter_splunk(spark, sf_dir):
    d = derived(spark, sf_dir)
    path = d.store.files("splunk", lambda p: _write_blocks(d, p))
    out = N.normalize(adapters.load_splunk(spark, path)[0])
    return out.select("sec", "event_type", "host", "user", "source_ip", "process_name", F.lower(F.element_at("metadata", "logname")).alias("log"))


@query("catalog_load", with_(f"""SELECT dataset_id, event_type, count(*) AS n FROM p, (VALUES ('e-1'), ('s-1')) v(dataset_id) WHERE {_WINDOWS} GROUP BY ALL"""))
def catalog_load(spark, sf_dir):
    """A catalog file read, each entry loaded by its adapter, with its provenance."""
    d = derived(spark, sf_dir)
    evtx = d.store.files("evtx", lambda p: tables.export_json(_evtx_rows(d).select("idx", F.to_json("c").alias("raw")), p, 500))
    splunk = d.store.files("splunk", lambda p: _write_blocks(d, p))
    entries = [("e-1", "real", "E", "evtx_csv_json", evtx), ("s-1", "real", "S", "splunk_log", splunk)]

    def write(path: str) -> None:
        listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "kind", "label", "adapter", "path"), e)]) for e in entries])
        d.spark.range(1).coalesce(1).select(F.to_json(F.struct(listed.alias("datasets"))).alias("value")).write.mode("overwrite").text(path)

    out = None
    for entry in adapters.read_catalog(spark, d.store.files("catalog", write)):
        rows = N.normalize(adapters.load_dataset(spark, entry)[0]).select(F.element_at("metadata", "dataset_id").alias("dataset_id"), "event_type")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("dataset_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sinks


@query("add_events", with_("""SELECT true AS replaced, count(*) AS rows, count(*) FILTER (WHERE n % 2 = 0) AS fresh, sum(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS versions FROM (SELECT event_id AS n FROM events)
  UNION ALL SELECT false, count(*), count(*) FILTER (WHERE n % 2 = 0), sum(CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END)::BIGINT FROM (SELECT event_id AS n FROM events)"""))  # fmt: skip
def add_events(spark, sf_dir):
    """Stored: all events but every fourth; batch: every second one, twice.  Both ways, and the second run of each changes nothing."""
    rows = derived(spark, sf_dir).telemetry.select("event_id", _number().alias("idx"))
    stored = rows.where("idx % 4 <> 0").withColumn("version", F.lit(1))
    batch = rows.where("idx % 2 = 0").withColumn("version", F.lit(2))
    batch = batch.unionByName(batch.withColumns({"version": F.lit(3), "idx": F.col("idx") + 1}))
    out = None
    for replace in (True, False):
        table, _ = tables.add_events(stored, batch, replace)
        again, _ = tables.add_events(table, batch, replace)
        one = again.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("idx") % 2 == 0, F.col("event_id"))).alias("fresh"), F.sum("version").alias("versions")).withColumn("replaced", F.lit(replace))
        out = one if out is None else out.unionByName(one)
    return out


@query("without_dataset", with_("""SELECT 'chains' AS name, count(*) AS n FROM ch WHERE chain NOT IN (SELECT chain FROM me WHERE scenario_id = 'SCN-2') UNION ALL SELECT 'detections', count(*) FROM det WHERE event_id NOT IN (SELECT event_id FROM p WHERE scenario_id = 'SCN-2')
  UNION ALL SELECT 'events', count(*) FROM p WHERE scenario_id <> 'SCN-2' UNION ALL SELECT 'members', count(*) FROM members WHERE chain NOT IN (SELECT chain FROM me WHERE scenario_id = 'SCN-2')""", DETECT, CORRELATE, CHAINS, recursive=True))  # fmt: skip
def without_dataset(spark, sf_dir):
    d = derived(spark, sf_dir)
    left = tables.without_dataset({"events": d.events, "detections": d.detections, "members": d.members, "chains": d.chains}, scenarios=("SCN-2",))
    return views.counts(**left)


@query("chain_tables", with_("""SELECT chain, risk_level, n AS members, events_in_order, facts FROM ch JOIN (SELECT chain, count(*) AS n, string_agg(event_id, ',' ORDER BY position) AS events_in_order FROM members GROUP BY chain) USING (chain)
  JOIN (SELECT chain, string_agg(type || place, ',' ORDER BY type, place) AS facts FROM ev GROUP BY chain) USING (chain)""", DETECT, CORRELATE, CHAINS, EVIDENCE, recursive=True))  # fmt: skip
def chain_tables(spark, sf_dir):
    """Chain tables written twice over and read back, each chain with its events and evidence."""
    d = derived(spark, sf_dir)
    folder = d.store.path("sink")
    for _ in range(2):
        tables.write_chains(folder, d.chains, d.members, d.evidence)
    chains, members, evidence = (spark.read.parquet(f"{folder}/{name}") for name in ("chains", "members", "evidence"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"]), ",")
    held = members.groupBy("chain").agg(F.count(F.lit(1)).alias("members"), ordered.alias("events_in_order"))
    facts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "place"))), lambda x: F.concat(x["type"], x["place"].cast("string"))), ",")
    return chains.select("chain", "risk_level").join(held, "chain").join(evidence.groupBy("chain").agg(facts.alias("facts")), "chain")


# ---------------------------------------------------------------- filters


@query("event_filter", with_("""SELECT event_id, sec, event_type, host FROM p WHERE event_type = 'PROCESS_CREATED' AND sec BETWEEN 1704070000 AND 1704100000 AND severity = 'INFO' AND scenario_id = 'SCN-1'
  AND (command_line ILIKE '%c_d.exe%' OR process_name ILIKE '%c_d.exe%' OR file_path ILIKE '%c_d.exe%' OR domain ILIKE '%c_d.exe%' OR host ILIKE '%c_d.exe%' OR "user" ILIKE '%c_d.exe%')
  AND event_id IN (SELECT event_id FROM members)""", DETECT, CORRELATE, CHAINS, recursive=True))  # fmt: skip
def event_filter(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = filters.filter_events(d.telemetry, "process_created", scenario_id="SCN-1", severity="info", start=1704070000, end=1704100000, search="c_d.exe", members=d.members)
    return found.select("event_id", "sec", "event_type", "host")


@query("event_page", with_("SELECT event_id, sec, host, (SELECT count(*) FROM p) AS total FROM p ORDER BY sec DESC NULLS LAST, event_id LIMIT 100 OFFSET 50"))
def event_page(spark, sf_dir):
    rows = derived(spark, sf_dir).telemetry.select("event_id", "sec", "host")
    return filters.page(rows, [F.desc_nulls_last("sec"), F.asc("event_id")], 100, 50)



