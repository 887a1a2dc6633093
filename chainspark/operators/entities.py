"""Entities, event links and relationships of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.functions.scalars import filled, process_value


def event_entities(events: DataFrame) -> DataFrame:
    """``event_id, sec, entity_type, value, role``: up to nine references, the first role of a value wins."""
    host = F.col("host")
    refs = [("HOST", host, "host"), ("USER", F.col("user"), "user"), ("IP", F.col("source_ip"), "src"), ("IP", F.col("destination_ip"), "dst"),
            ("DOMAIN", F.col("domain"), "domain"), ("FILE", F.col("file_path"), "path"), ("PROCESS", process_value(host, F.col("process_name")), "actor"),
            ("PROCESS", process_value(host, F.col("parent_process")), "parent")]
    if "technique_id" in events.columns:
        refs.append(("TECHNIQUE", F.upper(F.col("technique_id")), "technique"))
    made = [F.when(filled(F.trim(v)).isNotNull(), F.struct(F.lit(t).alias("entity_type"), F.trim(v).alias("value"), F.lit(r).alias("role"))) for t, v, r in refs]
    rows = events.select("event_id", "sec", F.array_compact(F.array(*made)).alias("refs"))
    names = F.transform("refs", lambda r: F.concat_ws("\x1f", r["entity_type"], r["value"]))
    first = F.filter("refs", lambda r, i: F.array_position("names", F.concat_ws("\x1f", r["entity_type"], r["value"])) == i + 1)
    return rows.withColumn("names", names).select("event_id", "sec", F.explode(first).alias("r")).select("event_id", "sec", "r.*")


def entities(events: DataFrame) -> DataFrame:
    """One row an entity: label, first and last seen, events."""
    label = F.when(F.col("entity_type") == "PROCESS", F.regexp_replace("value", "^[^:]*:", "")).otherwise(F.col("value"))
    found = event_entities(events).groupBy("entity_type", "value")
    seen = found.agg(F.min("sec").alias("first_seen"), F.max("sec").alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return seen.withColumn("label", label)


def relationships(events: DataFrame) -> DataFrame:
    """``event_id, source_type, source, target_type, target, relation`` by event type."""
    kind, host, user, path = F.col("event_type"), filled(F.col("host")), filled(F.col("user")), filled(F.col("file_path"))
    process, parent = (process_value(F.col("host"), F.col(c)) for c in ("process_name", "parent_process"))
    ip, domain = filled(F.col("destination_ip")), filled(F.col("domain"))
    spec = [
        (kind.isin("LOGIN_SUCCESS", "LOGIN_ATTEMPT", "AUTHENTICATION", "PRIVILEGE_CHANGE"), "USER", user, "HOST", host, "AUTHENTICATED"),
        (kind.isin("PROCESS_CREATED", "REMOTE_EXECUTION"), "HOST", host, "PROCESS", process, "RUNS"),
        (kind.isin("PROCESS_CREATED", "REMOTE_EXECUTION") & (parent != process), "PROCESS", parent, "PROCESS", process, "SPAWNED"),
        (kind == "FILE_CREATED", "PROCESS", process, "FILE", path, "CREATED"),
        (kind.isin("FILE_MODIFIED", "REGISTRY_MODIFIED"), "PROCESS", process, "FILE", path, "MODIFIED"),
        (kind == "NETWORK_CONNECTION", "PROCESS", process, "IP", ip, "CONNECTED"),
        (kind == "DNS_QUERY", "PROCESS", process, "DOMAIN", domain, "QUERIED"),
        (kind == "DNS_QUERY", "DOMAIN", domain, "IP", ip, "RESOLVES_TO"),
        (kind == "REMOTE_EXECUTION", "USER", user, "HOST", host, "REMOTELY_EXECUTED"),
        (kind == "SERVICE_CREATED", "PROCESS", process, "FILE", path, "INSTALLED"),
    ]
    made = [
        F.when(w & s.isNotNull() & t.isNotNull(), F.struct(F.lit(st).alias("source_type"), s.alias("source"), F.lit(tt).alias("target_type"), t.alias("target"), F.lit(r).alias("relation")))
        for w, st, s, tt, t, r in spec
    ]
    return events.select("event_id", "sec", F.explode(F.array_compact(F.array(*made))).alias("r")).select("event_id", "sec", "r.*")
