"""Registered queries of the analytics engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.operators import rules
from chainspark.plans.oracle_parts import DETECT, with_
from chainspark.plans.stored import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("telemetry_events", with_("SELECT * FROM p"))
def telemetry_events(spark, sf_dir):
    return derived(spark, sf_dir).telemetry.drop("timestamp")


DETECTION_COLUMNS = ("event_id", "rule_ord", "rule_id", "severity", "technique_id", "technique_name", "tactic", "title")


@query("detections_all", with_(f"SELECT {', '.join(DETECTION_COLUMNS)} FROM det", DETECT))
def detections_all(spark, sf_dir):
    return derived(spark, sf_dir).detections.select(*DETECTION_COLUMNS)


RULES = (
    "AUTH_BRUTE_FORCE", "AUTH_SUCCESS_AFTER_FAILURES", "PRIVILEGED_LOGON", "OFFICE_SPAWNS_POWERSHELL", "ENCODED_POWERSHELL",
    "SUSPICIOUS_POWERSHELL", "SUSPICIOUS_LOLBIN", "SUSPICIOUS_EXECUTABLE_CREATION", "SCRIPT_IN_USER_DIRECTORY",
    "UNUSUAL_OUTBOUND_CONNECTION", "SUSPICIOUS_DNS_QUERY", "MULTIPLE_REMOTE_PORTS", "REGISTRY_PERSISTENCE",
    "SUSPICIOUS_SERVICE_INSTALL", "REMOTE_EXECUTION", "SCHEDULED_TASK_CREATED", "CREDENTIAL_DUMPING_TOOL",
)


def _rule(name: str):
    @query(f"rule_{name.lower()}", with_(f"SELECT event_id, severity, technique_id, title FROM det WHERE rule_id = '{name}'", DETECT))
    def one(spark, sf_dir):
        return derived(spark, sf_dir).detections.where(F.col("rule_id") == name).select("event_id", "severity", "technique_id", "title")


for _name in RULES:
    _rule(_name)


@query("powershell_markers", with_("""SELECT event_id, 'what stands out: ' || concat_ws(', ', if(regexp_matches(cmd, '(^|[^a-z0-9_-])-(enc|encodedcommand|ec)($|[^a-z0-9_-])'), 'encoded command', NULL),
  if(regexp_matches(cmd, 'downloadstring|net[.]webclient'), 'download cradle', NULL), if(regexp_matches(cmd, '(^|[^a-z0-9_-])iex($|[^a-z0-9_-])'), 'invoke-expression', NULL)) AS why FROM det JOIN f USING (event_id) WHERE rule_id = 'SUSPICIOUS_POWERSHELL'""", DETECT))  # fmt: skip
def powershell_markers(spark, sf_dir):
    """What the evidence of suspicious commands says, by the markers they hold."""
    found = derived(spark, sf_dir).detections.where("rule_id = 'SUSPICIOUS_POWERSHELL'")
    return found.select("event_id", F.get(F.filter("evidence", lambda e: e["field"] == "command_line"), 0)["why"].alias("why"))


@query("best_detection", with_("SELECT event_id, rule_id, severity, technique_id, tactic, findings FROM best", DETECT))
def best_detection(spark, sf_dir):
    return rules.best_detection(derived(spark, sf_dir).detections).select("event_id", "rule_id", "severity", "technique_id", "tactic", "findings")


@query("events_enriched", with_("SELECT event_id, event_type, host, \"user\", technique_id, technique_name, tactic, findings FROM e", DETECT))
def events_enriched(spark, sf_dir):
    return derived(spark, sf_dir).events.select("event_id", "event_type", "host", "user", "technique_id", "technique_name", "tactic", "findings")


@query(
    "detections_by_host",
    with_("SELECT host, d.technique_id, d.severity, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM det d JOIN p USING (event_id) GROUP BY ALL", DETECT),
)
def detections_by_host(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = d.detections.select("event_id", "technique_id", "severity")
    joined = found.join(d.telemetry.select("event_id", "host", "sec"), "event_id")
    return joined.groupBy("host", "technique_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))



_EVIDENCE = """SELECT rule_id, field, count(*) AS n, count(*) FILTER (WHERE value IS NOT NULL) AS filled FROM (SELECT rule_id, field, CASE field WHEN 'user' THEN "user" WHEN 'host' THEN host WHEN 'note' THEN note WHEN 'parent_process' THEN parent_process
  WHEN 'process_name' THEN process_name WHEN 'command_line' THEN command_line WHEN 'file_path' THEN file_path WHEN 'destination_ip' THEN destination_ip WHEN 'destination_port' THEN destination_port::VARCHAR WHEN 'protocol' THEN protocol
  WHEN 'domain' THEN domain ELSE 'counted' END AS value FROM (SELECT rule_id, event_id, unnest(CASE rule_id WHEN 'PRIVILEGED_LOGON' THEN ['user', 'host', 'note'] WHEN 'OFFICE_SPAWNS_POWERSHELL' THEN ['parent_process', 'process_name', 'command_line']
  WHEN 'SUSPICIOUS_POWERSHELL' THEN ['command_line', 'parent_process'] WHEN 'SUSPICIOUS_LOLBIN' THEN ['process_name', 'command_line'] WHEN 'SUSPICIOUS_EXECUTABLE_CREATION' THEN ['file_path', 'process_name']
  WHEN 'UNUSUAL_OUTBOUND_CONNECTION' THEN ['destination_ip', 'destination_port', 'protocol'] WHEN 'SUSPICIOUS_DNS_QUERY' THEN ['domain', 'process_name'] WHEN 'REGISTRY_PERSISTENCE' THEN ['file_path', 'command_line']
  WHEN 'SUSPICIOUS_SERVICE_INSTALL' THEN ['file_path', 'command_line'] WHEN 'REMOTE_EXECUTION' THEN ['host', 'user', 'note'] WHEN 'SCHEDULED_TASK_CREATED' THEN ['file_path', 'command_line'] WHEN 'CREDENTIAL_DUMPING_TOOL' THEN ['process_name', 'command_line']
  WHEN 'AUTH_BRUTE_FORCE' THEN ['user', 'source_ip', 'failures'] WHEN 'AUTH_SUCCESS_AFTER_FAILURES' THEN ['user', 'source_ip', 'failures'] WHEN 'MULTIPLE_REMOTE_PORTS' THEN ['source_ip', 'destination_count'] ELSE ['command_line', 'process_name'] END) AS field FROM det) JOIN p USING (event_id)) GROUP BY ALL"""


@query("detection_evidence", with_(_EVIDENCE, DETECT))
def detection_evidence(spark, sf_dir):
    """The fields that findings show, how often, and how often with a value."""
    shown = derived(spark, sf_dir).detections.select("rule_id", F.inline("evidence"))
    return shown.groupBy("rule_id", "field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != "None").alias("filled"))
