"""Adapters of published dataset formats to raw records: field maps, message fields, issues, provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.sources import splits as S
from chainspark.sources.records import scan_json

# Placeholders of empty cells, event ids beside the usual ones, and keys that mark a row.
PLACEHOLDERS = ("", "-", "n/a", "none", "null")
EXTRA_TYPES = {"5156": "NETWORK_CONNECTION", "5158": "NETWORK_CONNECTION", "4648": "AUTHENTICATION", "4663": "FILE_MODIFIED"}
IDENTITY = (
    "EventID", "event_id", "TimeCreated", "timestamp", "time", "SystemTime", "Hostname", "Computer", "host", "SourceAddress", "IpAddress",
    "source_ip", "EventCode", "EventCodeName",
)
# Labels of a Windows message and the fields they fill, in order.
MESSAGE_LABELS = (
    ("Process Command Line", "command_line"), ("New Process Name", "process_name"), ("Creator Process Name", "parent_process"),
    ("Process Name", "process_name"), ("Image Name", "process_name"), ("Account Name", "user"), ("Destination Address", "destination_ip"),
    ("Source Address", "source_ip"), ("Destination Port", "destination_port"), ("Source Port", "source_port"), ("New Process ID", "process_id"),
)
# Fields of each format, and where each canonical field comes from.
OTRF = {
    "timestamp": ("TimeCreated", "timestamp", "@timestamp"), "host": ("Hostname", "Computer", "host"), "source_ip": ("SourceAddress", "src_ip"),
    "destination_ip": ("DestAddress", "DestinationIp", "dst_ip"), "source_port": ("SourcePort",), "destination_port": ("DestPort", "DestinationPort"),
    "protocol": ("Protocol",), "process_name": ("Application", "Image"), "user": ("TargetUserName", "UserName", "AccountName"), "domain": ("QueryName",),
}
EVTX = {
    "timestamp": ("SystemTime", "timestamp"), "host": ("Computer", "Hostname"), "source_ip": ("IpAddress", "SourceAddress"), "source_port": ("IpPort", "SourcePort"),
    "destination_ip": ("DestAddress",), "destination_port": ("DestPort",), "user": ("TargetUserName", "SubjectUserName"), "process_name": ("ProcessName", "Application"),
    "parent_process": ("ParentProcessName", "CreatorProcessName"), "command_line": ("CommandLine",), "protocol": ("Protocol",), "tactic": ("EVTX_Tactic",),
}
SPLUNK_META = ("SourceName", "EventType", "Type", "TaskCategory", "OpCode", "RecordNumber", "Keywords", "LogName")
STAMP = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} (AM|PM)$"
PAIR = r"^([A-Za-z][A-Za-z0-9_]*)=(.*)$"
EVTX_SAMPLE_IDS = ("1", "3", "7", "11", "12", "13", "22", "4624", "4625", "4672", "4688", "4697", "4698", "7045", "5156", "5158", "4648", "4663")
EVTX_ALWAYS = ("11", "13", "4698", "7045", "4697")

Loaded = tuple[DataFrame, DataFrame]


def clean(value: Column) -> Column:
    """Trimmed text, null for empty cells and placeholders."""
    bare = F.trim(value)
    return F.when(~F.lower(bare).isin(*PLACEHOLDERS), bare)


def message_fields(message: Column) -> dict[str, Column]:
    """Canonical fields named in a message, each from its first label that has a value."""
    found: dict[str, list[Column]] = {}
    for label, field in MESSAGE_LABELS:
        value = clean(F.regexp_extract(message, rf"(?im)^\s*{label}\s*:\s*(.+)$", 1))
        if field == "process_id":
            digits = F.regexp_extract(value, r"0x[0-9a-fA-F]+|\d+", 0)
            value = F.when(digits.startswith("0x"), F.conv(F.substring(digits, 3, 16), 16, 10)).otherwise(digits)
            value = F.when(value != "", value)
        found.setdefault(field, []).append(value)
    return {f: F.coalesce(*values) for f, values in found.items()}


def _protocol(value: Column) -> Column:
    return F.when(value.isin("6", "TCP"), "tcp").when(value.isin("17", "UDP"), "udp").otherwise(F.lower(value))


def _digits(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+$"), value)


def _record(values: dict[str, Column], metadata: dict[str, Column]) -> Column:
    """A raw record as JSON; nulls are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()], F.struct(*[v.alias(k) for k, v in metadata.items()]).alias("metadata")))


def _typed(event_id: Column) -> dict[str, Column]:
    extra = F.element_at(F.create_map(*[F.lit(x) for pair in EXTRA_TYPES.items() for x in pair]), F.coalesce(event_id, F.lit("")))
    return {"EventID": event_id, "event_type": extra}


def _issue(rows: DataFrame, message: str) -> DataFrame:
    return rows.select("file", "idx", F.lit(message).alias("message"))


def _mapped(scanned: Loaded, names: dict[str, tuple[str, ...]], source: str, metadata: dict[str, str], message: str | None) -> Loaded:
    rows, issues = scanned
    rows = rows.withColumn("m", F.from_json("raw", "map<string,string>"))
    at = lambda k: F.element_at("m", F.lit(k))
    known = F.coalesce(*[clean(at(k)) for k in IDENTITY]).isNotNull()
    is_object = F.col("m").isNotNull()
    values: dict[str, Column] = {}
    for field, keys in names.items():
        value = F.coalesce(*[clean(at(k)) for k in keys])
        values[field] = _digits(value) if field.endswith("_port") else _protocol(value) if field == "protocol" else value
    event_id = clean(at("EventID"))
    if message:
        for field, value in message_fields(at(message)).items():
            values[field] = F.coalesce(values[field], value) if field in values else value
    meta = {"dataset": F.lit(source), **{k: clean(at(v)) for k, v in metadata.items()}, "event_id_raw": event_id, "row_index": F.col("line")}
    if message:
        meta["message"] = F.substring(clean(at(message)), 1, 1000)
    made = _record({**values, **_typed(event_id), "source": F.lit(source)}, meta)
    # The mapped record must still name an event, a time, a host or a source.
    told = F.coalesce(values["timestamp"], values["host"], values["source_ip"], event_id).isNotNull()
    out = rows.where(is_object & known & told).select("file", "line", "idx", made.alias("raw"))
    issues = issues.unionByName(_issue(rows.where(~is_object), "row is no object"))
    issues = issues.unionByName(_issue(rows.where(is_object & ~known), "row has no time, host or event id"))
    return out, issues.unionByName(_issue(rows.where(is_object & known & ~told), "row cannot be mapped"))


def load_otrf(spark: SparkSession, path: str) -> Loaded:
    """Records and issues of Windows events with ``EventID``, ``TimeCreated``, ``Hostname``, ``Message`` and the like."""
    return _mapped(scan_json(spark, path), OTRF, "otrf-security-datasets", {"channel": "Channel"}, "Message")


def load_evtx(spark: SparkSession, path: str) -> Loaded:
    """Records and issues of rows with ``SystemTime``, ``Computer``, ``EVTX_Tactic`` and the like."""
    return _mapped(scan_json(spark, path), EVTX, "evtx-attack-samples", {"evtx_file": "EVTX_FileName", "channel": "Channel"}, None)


def load_splunk(spark: SparkSession, path: str) -> Loaded:
    """Records and issues of text files in blocks: a time line, ``Key=Value`` lines, and lines that carry ``Message`` on.

    A large file is read by many tasks; a block that reaches over a split is still one.
    Where ``Message`` is carried on, only those lines are its text.
    """
    read = S.lines(spark, path)
    rows = S.numbered(read, S.count_splits(read)).withColumnRenamed("value", "text")
    starts = F.trim("text").rlike(STAMP)
    lines = S.since(rows, starts).where("record is not null").select("file", "record", F.col("line").alias("pos"), "text", starts.alias("starts"))
    key = F.when(~F.col("starts"), F.regexp_extract("text", PAIR, 1))
    within = Window.partitionBy("file", "record").orderBy("pos")
    lines = lines.withColumn("key", F.when(key != "", key)).withColumn("of", F.last("key", True).over(within))
    pair = F.when(F.col("key").isNotNull(), F.struct("pos", "key", F.regexp_extract("text", PAIR, 2).alias("v")))
    more = F.when(F.col("key").isNull() & (F.col("of") == "Message") & ~F.col("starts") & (F.trim("text") != ""), F.struct("pos", F.trim("text").alias("v")))
    # A block is one event, so its lines are few.
    grouped = lines.groupBy("file", "record").agg(F.min("pos").alias("line"), F.max(F.when(F.col("starts"), F.trim("text"))).alias("stamp"), F.sort_array(F.collect_list(pair)).alias("pairs"), F.sort_array(F.collect_list(more)).alias("more"))
    # Of a repeated key the last counts.
    last = F.filter("pairs", lambda p: ~F.exists("pairs", lambda q: (q["key"] == p["key"]) & (q["pos"] > p["pos"])))
    rows = grouped.select(
        "file", "line", F.col("record").alias("idx"), "stamp",
        F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["v"]))).alias("m"), F.transform("more", lambda x: x["v"]).alias("more"),
    )
    at = lambda k: F.element_at("m", F.lit(k))
    message = clean(F.when(F.size("more") > 0, F.array_join("more", "\n")).otherwise(at("Message")))
    stamp = F.try_to_timestamp("stamp", F.lit("MM/dd/yyyy hh:mm:ss a"))
    values = {
        "timestamp": F.coalesce(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.col("stamp")),
        "host": clean(F.coalesce(at("ComputerName"), at("Computer"))),
        **_typed(clean(at("EventCode"))),
        **message_fields(message),
        "source": F.lit("splunk-attack-data"),
    }
    meta = {"dataset": F.lit("splunk-attack-data"), "row_index": F.col("line"), **{k.lower(): clean(at(k)) for k in SPLUNK_META}, "message": F.substring(message, 1, 1000)}
    filled = (F.size("m") > 0) | (F.size("more") > 0)
    return rows.where(filled).select("file", "line", "idx", _record(values, meta).alias("raw")), _issue(rows.where(~filled), "block has no fields")


def evtx_sample(rows: DataFrame, a_file: int = 60, in_all: int = 400) -> DataFrame:
    """A capped sample (the feature) of ``idx`` and the columns of an EVTX table.

    Known events that say something, at most ``a_file`` of a source file and ``in_all`` in all, in order.
    """
    said = lambda c: ~F.coalesce(F.trim(c), F.lit("")).isin("", "-")
    useful = said("CommandLine") | said("ProcessName") | said("IpAddress") | said("DestAddress") | F.col("EventID").isin(*EVTX_ALWAYS)
    place = F.row_number().over(Window.partitionBy("EVTX_FileName").orderBy("idx"))
    kept = rows.where(F.col("EventID").isin(*EVTX_SAMPLE_IDS) & useful).withColumn("place", place).where(F.col("place") <= a_file)
    return kept.drop("place").orderBy("idx").limit(in_all)


ADAPTERS: dict[str, Callable[[SparkSession, str], Loaded]] = {"otrf_json": load_otrf, "evtx_csv_json": load_evtx, "splunk_log": load_splunk}


def read_catalog(spark: SparkSession, path: str) -> list[dict]:
    """Entries of a catalog file: an object with a list ``datasets``.  The catalog names datasets, so it is small."""
    table = spark.read.json(path, multiLine=True)
    if "datasets" not in table.columns:
        raise ValueError("a catalog is an object with a list 'datasets'")
    return [r.asDict(recursive=True) for r in table.select(F.inline("datasets")).collect()]


def load_dataset(spark: SparkSession, entry: dict, root: str = "") -> Loaded:
    """Records of a catalog entry by its adapter, stamped with where they come from; an unknown adapter is an error."""
    adapter = ADAPTERS.get(entry.get("adapter") or "")
    if adapter is None:
        raise ValueError(f"unknown adapter {entry.get('adapter')!r} of {entry.get('id')!r}; known are {', '.join(sorted(ADAPTERS))}")
    rows, issues = adapter(spark, f"{root}{entry['path']}")
    return stamped(rows, entry), issues


def stamped(rows: DataFrame, entry: dict) -> DataFrame:
    """Records whose metadata names the dataset's label, id and kind; what they say themselves stays."""
    own = {f"dataset_{k}": entry.get(k) for k in ("label", "id", "kind")}
    given = F.create_map(*[x for k, v in own.items() if v is not None for x in (F.lit(k), F.lit(str(v)))])
    record = F.from_json("raw", "map<string,string>")
    meta = F.coalesce(F.from_json(F.element_at(record, F.lit("metadata")), "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    added = F.map_filter(given, lambda k, v: ~F.map_contains_key(meta, k))
    rest = F.map_filter(record, lambda k, v: k != "metadata")
    body = F.regexp_replace(F.to_json(rest), r"^\{", "")
    joined = F.to_json(F.map_concat(meta, added))
    return rows.withColumn("raw", F.concat(F.lit('{"metadata":'), joined, F.when(F.size(rest) > 0, F.lit(",")).otherwise(F.lit("")), body))
