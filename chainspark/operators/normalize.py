"""Raw JSON records to canonical events: aliases, types, coercion and structured issues, in one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.config import DEFAULT
from chainspark.functions.scalars import basename, filled

# Canonical fields and the names they are known by.
ALIASES = {
    "timestamp": ("timestamp", "time", "event_time", "eventtime", "@timestamp", "date", "created", "utc_time", "datetime"),
    "event_type": ("event_type", "eventtype", "type", "event", "action", "category", "log_type", "kind"),
    "host": ("host", "hostname", "computer", "machine", "device", "endpoint", "agent", "computername"),
    "user": ("user", "username", "account", "account_name", "subjectusername", "targetusername", "user_name", "principal"),
    "source_ip": ("source_ip", "src_ip", "srcip", "sourceip", "saddr", "src", "client_ip", "ip_address"),
    "destination_ip": ("destination_ip", "dst_ip", "dstip", "destinationip", "daddr", "dst", "server_ip", "remote_ip"),
    "source_port": ("source_port", "src_port", "sport", "sourceport"),
    "destination_port": ("destination_port", "dst_port", "dport", "destinationport"),
    "protocol": ("protocol", "proto", "l4_proto"),
    "process_name": ("process_name", "process", "image", "image_name", "imagename", "newprocessname", "proc"),
    "process_id": ("process_id", "pid", "processid", "newprocessid"),
    "parent_process": ("parent_process", "parent_image", "parentimage", "parent_name", "parentprocessname", "ppid_name"),
    "parent_process_id": ("parent_process_id", "ppid", "parentprocessid", "parent_pid"),
    "command_line": ("command_line", "commandline", "cmdline", "cmd", "command", "process_command_line"),
    "file_path": ("file_path", "filepath", "path", "targetfilename", "filename", "file_name", "target_path", "service_path", "binary_path", "imagepath"),
    "file_hash": ("file_hash", "hash", "hashes", "sha256", "md5", "sha1"),
    "domain": ("domain", "query", "dns_query", "queryname", "dns_name", "qname", "remote_host"),
    "severity": ("severity", "level", "risk", "priority"),
    "technique_id": ("technique_id", "techniqueid", "technique", "mitre_id", "attack_id"),
    "technique_name": ("technique_name", "techniquename", "mitre_name"),
    "tactic": ("tactic", "mitre_tactic"),
    "source": ("source", "sensor", "product", "log_source", "sourcetype", "provider"),
    "metadata": ("metadata", "extra", "fields", "additional", "properties"),
}
# Names and Windows ids that stand for event types.
TYPE_NAMES = {
    "login_attempt": "LOGIN_ATTEMPT",
    "logon_attempt": "LOGIN_ATTEMPT",
    "failed_logon": "LOGIN_ATTEMPT",
    "login_failure": "LOGIN_ATTEMPT",
    "failed_login": "LOGIN_ATTEMPT",
    "auth_failure": "LOGIN_ATTEMPT",
    "login_success": "LOGIN_SUCCESS",
    "logon_success": "LOGIN_SUCCESS",
    "successful_logon": "LOGIN_SUCCESS",
    "process_created": "PROCESS_CREATED",
    "process_create": "PROCESS_CREATED",
    "processcreation": "PROCESS_CREATED",
    "new_process": "PROCESS_CREATED",
    "file_created": "FILE_CREATED",
    "file_create": "FILE_CREATED",
    "filewrite": "FILE_CREATED",
    "file_written": "FILE_CREATED",
    "file_modified": "FILE_MODIFIED",
    "file_change": "FILE_MODIFIED",
    "file_delete": "FILE_MODIFIED",
    "registry_modified": "REGISTRY_MODIFIED",
    "registry_event": "REGISTRY_MODIFIED",
    "registry_change": "REGISTRY_MODIFIED",
    "regvalue_set": "REGISTRY_MODIFIED",
    "network_connection": "NETWORK_CONNECTION",
    "network_connect": "NETWORK_CONNECTION",
    "netflow": "NETWORK_CONNECTION",
    "connection": "NETWORK_CONNECTION",
    "outbound_connection": "NETWORK_CONNECTION",
    "dns_query": "DNS_QUERY",
    "dns": "DNS_QUERY",
    "query": "DNS_QUERY",
    "authentication": "AUTHENTICATION",
    "auth": "AUTHENTICATION",
    "privilege_change": "PRIVILEGE_CHANGE",
    "privilege_escalation": "PRIVILEGE_CHANGE",
    "special_logon": "PRIVILEGE_CHANGE",
    "special_privileges": "PRIVILEGE_CHANGE",
    "privilege_assignment": "PRIVILEGE_CHANGE",
    "service_created": "SERVICE_CREATED",
    "service_install": "SERVICE_CREATED",
    "service_installed": "SERVICE_CREATED",
    "service_installation": "SERVICE_CREATED",
    "remote_execution": "REMOTE_EXECUTION",
    "remote_exec": "REMOTE_EXECUTION",
    "psexec": "REMOTE_EXECUTION",
}
WINDOWS_IDS = {
    "1": "PROCESS_CREATED", "3": "NETWORK_CONNECTION", "7": "PROCESS_CREATED", "11": "FILE_CREATED", "12": "REGISTRY_MODIFIED", "13": "REGISTRY_MODIFIED",
    "14": "REGISTRY_MODIFIED", "22": "DNS_QUERY", "4624": "LOGIN_SUCCESS", "4625": "LOGIN_ATTEMPT", "4672": "PRIVILEGE_CHANGE", "4688": "PROCESS_CREATED",
    "4697": "SERVICE_CREATED", "4698": "SERVICE_CREATED", "7045": "SERVICE_CREATED",
}
SEVERITY_NAMES = {"ERR": "HIGH", "ERROR": "HIGH", "WARN": "MEDIUM", "NOTICE": "LOW", "INFORMATIONAL": "INFO", **{s: s for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")}}
TYPE_SEVERITY = {"LOGIN_ATTEMPT": "LOW", "PRIVILEGE_CHANGE": "MEDIUM", "SERVICE_CREATED": "MEDIUM", "REMOTE_EXECUTION": "HIGH"}
ID_KEYS = ("event_id", "record_id", "telemetry_id", "unique_id", "uuid")
GROUND_TRUTH_KEYS = ("gt_id", "_gt_id", "GT")
COERCED = ("source_port", "destination_port", "process_id", "parent_process_id", "technique_id")
#: The end of the year 2100.
LAST_SECOND = 4_133_980_799
TECHNIQUE = r"^T\d{4}(\.\d{3})?$"


def _bare(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _pick(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.expr(f"map({', '.join(repr(x) for pair in table.items() for x in pair)})"), F.coalesce(key, F.lit("")))


def _bare_names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in sorted({_bare(n) for n in names})])


def _first(names: tuple[str, ...]) -> Column:
    """The first key of the record, in its own order, that is one of the names and has a value; ``ks`` are the keys as compared."""
    found = F.get(F.array_intersect("ks", _bare_names(names)), 0)
    return F.get("fields", (F.array_position("ks", found) - 1).cast("int"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?\d{1,18}$"), F.trim(text).try_cast("bigint"))


def _time(value: Column, number: Column) -> Column:
    """ISO forms, day-first before month-first dates, and numeric epochs in seconds or milliseconds; 1970 to 2100."""
    text = F.trim(value)
    clock = r"(\d\d:\d\d:\d\d)"
    shapes = ((rf"^(\d{{4}})/(\d\d)/(\d\d) {clock}$", r"$1-$2-$3 $4"), (rf"^(\d\d)/(\d\d)/(\d{{4}}) {clock}$", r"$3-$2-$1 $4"), (rf"^(\d\d)/(\d\d)/(\d{{4}}) {clock}$", r"$3-$1-$2 $4"))
    iso, zoned = text.rlike(r"^\d{4}-\d\d-\d\d"), text.rlike(r"([Zz]|[+-]\d\d:?\d\d)$")
    # A time without a zone is UTC, whatever the session's zone.
    naive = F.coalesce(F.when(iso, text.try_cast("timestamp_ntz")), *[F.when(text.rlike(p), F.regexp_replace(text, p, to).try_cast("timestamp_ntz")) for p, to in shapes])
    utc = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), naive))
    parsed = F.when(iso & zoned, text.try_cast("timestamp")).otherwise(utc)
    epoch = F.timestamp_micros((F.when(number > 1e12, number / 1000).otherwise(number) * 1_000_000).cast("bigint"))
    out = F.when(number.isNotNull(), epoch).when(~text.rlike(r"^\d+$"), parsed)
    return F.when(F.unix_seconds(out).between(0, LAST_SECOND), out)


def _fields() -> Column:
    """Entries of the record in its own order: key, key as compared, trimmed lower key, text, value."""
    entry = lambda e: F.struct(
        e["key"].alias("key"),
        F.regexp_replace(F.lower(F.trim(e["key"])), "[^a-z0-9]", "").alias("k"),
        F.trim(F.lower(e["key"])).alias("name"),
        e["value"].cast("string").alias("s"),
        e["value"].alias("v"),
    )
    found = F.filter(F.transform(F.map_entries("m"), entry), lambda e: F.coalesce(e["s"] != "", F.lit(False)))
    none = F.array().cast("array<struct<key:string,k:string,name:string,s:string,v:variant>>")
    return F.coalesce(found, none)


def _metadata() -> Column:
    """The record's metadata object (32 entries) or a note of it, under the fields that nothing else consumed (24)."""
    given = _first(ALIASES["metadata"])
    inner = F.filter(F.map_entries(F.from_json(given["s"], "map<string,string>")), lambda e: e["value"].isNotNull())
    pair = lambda k, v: F.struct(F.substring(k, 1, 64).alias("k"), F.substring(v, 1, 512).alias("v"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    own = F.when(F.schema_of_variant(given["v"]).startswith("OBJECT"), F.transform(F.slice(inner, 1, 32), lambda e: pair(e["key"], e["value"])))
    own = F.coalesce(own, F.when(given["s"].isNotNull(), F.array(pair(F.lit("note"), given["s"]))), none)
    used = sorted({_bare(n) for names in ALIASES.values() for n in names} | {_bare(n) for n in ALIASES})
    left = F.filter("fields", lambda e: ~(e["k"].isin(*used) | e["name"].isin(*ID_KEYS) | e["key"].isin(*GROUND_TRUTH_KEYS)))
    both = F.concat(own, F.transform(F.slice(left, 1, 24), lambda e: pair(e["key"], e["s"])))
    # Equal names: the last one wins, so keep an entry only where no later one has its name.
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, 56), lambda o: o["k"] == e["k"]))
    return F.get(F.transform(F.array(both), lambda b: F.map_from_entries(last(b))), 0)


def normalize(records: DataFrame, scenario_id: str | None = None) -> DataFrame:
    """Canonical events of ``records`` (``idx, raw``), with ``issues`` and a null ``event_type`` where none can be told.

    A record that is no object, or is empty, has a null type and one issue.  ``note`` joins the
    values of ``metadata`` for rules that search it.  A record without an id of its own is told by its text and
    its place: ``file`` and ``line`` where the scan gives them, else ``idx``.
    """
    place = ["file", "line"] if {"file", "line"} <= set(records.columns) else ["idx"]
    parsed = records.select("idx", "raw", F.concat_ws("|", *place).alias("place"), F.from_json("raw", "map<string,variant>").alias("m"))
    rows = parsed.withColumn("fields", _fields()).withColumn("ks", F.transform("fields", lambda e: e["k"]))
    rows = rows.withColumns({f"f_{c}": _first(names)["s"] for c, names in ALIASES.items()})
    stamp = _first(ALIASES["timestamp"])
    told = F.trim(F.col("f_event_type"))
    by_id = F.get(F.filter("fields", lambda e: e["k"].isin("eventid", "eventidnumeric", "id") & e["s"].rlike(r"^\d+$")), 0)["s"]
    has = lambda *names: F.arrays_overlap("ks", F.array(*[F.lit(n) for n in names]))
    guess = F.when(has("queryname"), "DNS_QUERY").when(has("targetfilename") | (has("path") & ~has("image")), "FILE_CREATED").when(has("parentimage"), "PROCESS_CREATED")
    types = {t: t for t in TYPE_NAMES.values()}
    known = F.coalesce(_pick(F.lower(told), TYPE_NAMES), _pick(F.upper(told), types), _pick(told, WINDOWS_IDS), _pick(by_id, WINDOWS_IDS), guess)
    low = lambda c, n: F.substring(F.lower(F.trim(F.col(f"f_{c}"))), 1, n)
    user = F.split(F.element_at(F.split(low("user", 255), r"\\"), -1), "@")[0]
    number = lambda c: _number(F.col(f"f_{c}"))
    port = lambda c: F.when(number(c).between(0, 65535), number(c)).cast("int")
    pid = lambda c: F.when(number(c) >= 0, number(c)).cast("long")
    process = lambda c: F.substring(F.coalesce(filled(basename(F.trim(F.col(f"f_{c}")))), F.trim(F.col(f"f_{c}"))), 1, 255)
    kept = lambda c, n: F.substring(F.trim(F.col(f"f_{c}")), 1, n)
    technique = F.upper(F.trim(F.col("f_technique_id")))
    given = F.trim(F.get(F.filter("fields", lambda e: e["name"].isin(*ID_KEYS)), 0)["s"])
    given = F.when((given != "") & ~F.regexp_replace(F.lower(given), "[^a-z0-9]", "").isin("id", "eventid"), given)
    made = F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "place", "raw"), 256), 1, 24)))
    tagged = F.filter("fields", lambda e: e["key"].isin(*GROUND_TRUTH_KEYS))
    truth = F.array_sort(F.transform(tagged, lambda e: F.struct(F.array_position(F.array(*[F.lit(k) for k in GROUND_TRUTH_KEYS]), e["key"]).alias("at"), e["s"].alias("s"))))
    truth = F.get(truth, 0)["s"]
    out = {
        "event_id": F.coalesce(F.concat(F.lit("EVT-"), F.substring(given, 1, 32)), made),
        "timestamp": _time(stamp["s"], F.when(F.schema_of_variant(stamp["v"]).rlike("^(BIGINT|DOUBLE|DECIMAL)"), stamp["s"].try_cast("double"))),
        "event_type": F.when(F.upper(told).rlike(TECHNIQUE), None).otherwise(known),
        "host": filled(low("host", 255)),
        "user": filled(user),
        "source_ip": filled(kept("source_ip", 64)),
        "destination_ip": filled(kept("destination_ip", 64)),
        "source_port": port("source_port"),
        "destination_port": port("destination_port"),
        "protocol": filled(low("protocol", 16)),
        "process_name": process("process_name"),
        "process_id": pid("process_id"),
        "parent_process": process("parent_process"),
        "parent_process_id": pid("parent_process_id"),
        "command_line": kept("command_line", 8192),
        "file_path": kept("file_path", 1024),
        "file_hash": kept("file_hash", 128),
        "domain": filled(low("domain", 255)),
        "technique_id": F.when(technique.rlike(TECHNIQUE), technique),
        "technique_name": kept("technique_name", 255),
        "tactic": F.upper(kept("tactic", 64)),
        "source": F.lower(kept("source", 64)),
        "gt_id": F.substring(truth, 1, 32),
        "metadata": F.when(F.size("fields") > 0, _metadata()),
    }
    rows = rows.withColumns({f"o_{c}": v for c, v in out.items()})
    of = lambda c: F.col(f"o_{c}")
    empty = F.size("fields") == 0

    def issue(when: Column, scope: str, field: str, message: str) -> Column:
        return F.when(when, F.struct(F.lit(scope).alias("scope"), F.lit(field).alias("field"), F.lit(message).alias("message")))

    bad = lambda c: F.col(f"f_{c}").isNotNull() & of(c).isNull()
    nobody = F.coalesce(of("host"), of("user"), of("source_ip"), of("destination_ip")).isNull()
    issues = F.array_compact(
        F.array(
            issue(empty, "record", "record", "not an object, or empty"),
            issue(~empty & of("event_type").isNull(), "record", "event_type", "event type cannot be told"),
            issue(~empty & of("timestamp").isNull(), "field", "timestamp", "missing or unreadable time"),
            *[issue(F.length(F.trim(F.col(f"f_{c}"))) > 64, "field", c, "address cut to 64 characters") for c in ("source_ip", "destination_ip")],
            *[issue(bad(c), "field", c, "value out of range or unreadable") for c in COERCED],
            issue(~empty & nobody, "field", "identity", "no host, user or address"),
        )
    )
    severity = F.coalesce(_pick(F.upper(F.trim(F.col("f_severity"))), SEVERITY_NAMES), _pick(of("event_type"), TYPE_SEVERITY), F.lit("INFO"))
    rows = rows.select("idx", *[of(c).alias(c) for c in out], F.unix_timestamp(of("timestamp")).alias("sec"), severity.alias("severity"), issues.alias("issues"))
    note = F.array_join(F.map_values("metadata"), " ")
    return rows.withColumns({"note": note, "scenario_id": F.lit(scenario_id).cast("string")})


def capped_batch(records: DataFrame, most: int = DEFAULT.max_events_per_ingest) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` records by ``idx``, and one issue row where there were more (a feature: the size of one ingest).

    Only the places of the first ``most`` are gathered to find where to cut; they need not be without gaps.
    """
    first = records.select("idx").orderBy("idx").limit(most)
    last = first.agg(F.max("idx")).scalar()
    over = records.agg(F.count(F.lit(1)).alias("received")).where(F.col("received") > most)
    return records.where(F.col("idx") <= last), over.select(F.lit("batch").alias("scope"), F.col("received"), F.lit(most).alias("taken"))


def issue_rows(events: DataFrame) -> DataFrame:
    """``idx, scope, field, message``: one row an issue."""
    # An outer generator: an inner one has the planner filter by the issues first, which makes every field anew inside the filter.
    return events.select("idx", F.inline_outer("issues")).where("scope is not null")


def ingest_report(events: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """One row: received, stored, duplicates, skipped, issue_count, and detections where they are given."""
    stored = F.countDistinct(F.when(F.col("event_type").isNotNull(), F.col("event_id")))
    typed = F.count_if(F.col("event_type").isNotNull())
    report = events.agg(
        F.count(F.lit(1)).alias("received"),
        stored.alias("stored"),
        (typed - stored).alias("duplicates"),
        F.count_if(F.col("event_type").isNull()).alias("skipped"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("long").alias("issue_count"),
    )
    if detections is None:
        return report
    return report.withColumn("detections", detections.agg(F.count(F.lit(1))).scalar())
