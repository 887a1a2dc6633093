"""Streaming forms: rules, counts, deduplication, indicators, and entities by micro-batch; ``logons`` and ``chain_store`` hold state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.config import DEFAULT, Settings
from chainspark.operators import indicators
from chainspark.operators.entities import event_entities
from chainspark.operators.rules import stateless


def stream_detections(events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Findings of the fourteen stateless rules over a stream of canonical events (append)."""
    return stateless(events, cfg)


def stream_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", cfg: Settings = DEFAULT) -> DataFrame:
    """Findings a rule in tumbling windows of event time; rows later than ``late`` are dropped."""
    found = stateless(events.withWatermark("timestamp", late), cfg, keep=("timestamp",))
    windowed = found.groupBy(F.window("timestamp", width), "rule_id")
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "rule_id", "n")


def stream_distinct(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each event id within the watermark."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])


def stream_matches(events: DataFrame, listed: DataFrame) -> DataFrame:
    """Indicator matches of a stream against a static table."""
    return indicators.match(events, listed)


def stream_entities(events: DataFrame) -> DataFrame:
    """First and last seen and events of each entity so far (update mode)."""
    found = event_entities(events).groupBy("entity_type", "value")
    return found.agg(F.min("sec").alias("first_seen"), F.max("sec").alias("last_seen"), F.count(F.lit(1)).alias("events"))


def merge_entities(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of events: one folder a batch with the batch's own entities; ``read_entities`` adds them up.

    A batch that is repeated after a failure writes its own folder again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream_entities(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return merge


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """``entity_type, value, first_seen, last_seen, events`` over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("entity_type", "value").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))
