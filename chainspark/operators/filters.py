"""Event, chain and technique filters, with pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.dims import TECHNIQUES

SEARCHED = ("command_line", "process_name", "file_path", "domain", "host", "user")


def filter_events(
    events: DataFrame,
    event_type: str | None = None,
    host: str | None = None,
    user: str | None = None,
    scenario_id: str | None = None,
    severity: str | None = None,
    start: int | None = None,
    end: int | None = None,
    search: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Events that meet every condition given.

    ``start`` and ``end`` are seconds, both inclusive.  ``search`` is a part of any searched column in
    either case, in which ``%`` and ``_`` stand for any text and any character.  ``members`` are the
    rows of the chains to stay within.
    """
    equal = {"event_type": event_type and event_type.upper(), "host": host and host.lower(), "user": user and user.lower(), "scenario_id": scenario_id, "severity": severity and severity.upper()}
    for c, value in equal.items():
        if value:
            events = events.where(F.col(c) == value)
    if start is not None:
        events = events.where(F.col("sec") >= start)
    if end is not None:
        events = events.where(F.col("sec") <= end)
    if search:
        events = events.where(_any([F.col(c).ilike(f"%{search}%") for c in SEARCHED if c in events.columns]))
    if members is not None:
        events = events.join(members.select("event_id"), "event_id", "left_semi")
    return events


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def filter_chains(
    chains: DataFrame, status: str | None = None, is_attack: bool | None = None, scenario_id: str | None = None, host: str | None = None, min_confidence: float | None = None
) -> DataFrame:
    """Chains that meet every condition given; a host must be one of the chain's, a scenario one of its events'."""
    if status:
        chains = chains.where(F.col("status") == status.upper())
    if is_attack is not None:
        chains = chains.where(F.col("is_attack") == is_attack)
    if scenario_id:
        chains = chains.where(F.array_contains("scenarios", scenario_id))
    if host:
        chains = chains.where(F.array_contains("hosts", host.lower()))
    if min_confidence is not None:
        chains = chains.where(F.col("confidence") >= min_confidence)
    return chains


def filter_techniques(techniques: DataFrame, tactic: str | None = None, sub_techniques: bool = True) -> DataFrame:
    """Catalog rows of a tactic, with or without sub-techniques, by id."""
    if tactic:
        techniques = techniques.where(F.col("tactic") == tactic.upper())
    if not sub_techniques:
        techniques = techniques.where(~F.col("technique_id").contains("."))
    return techniques.orderBy("technique_id")


def lookup_techniques(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``technique_id, name, tactic`` of upper-cased ids, from the stored table, else from the catalog."""
    spark = wanted.sparkSession
    catalog = spark.createDataFrame(list(TECHNIQUES), "technique_id string, c_name string, c_tactic string")
    ids = wanted.select(F.upper("technique_id").alias("technique_id")).distinct()
    own = stored.select(F.upper("technique_id").alias("technique_id"), F.col("name").alias("s_name"), F.col("tactic").alias("s_tactic")).dropDuplicates(["technique_id"])
    met = ids.join(own, "technique_id", "left").join(F.broadcast(catalog), "technique_id", "left")
    return met.select("technique_id", F.coalesce("s_name", "c_name").alias("name"), F.coalesce("s_tactic", "c_tactic").alias("tactic")).where("name is not null")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows (the feature), each with the total of all rows."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
