"""Raw JSON lines as a stream: normalised events and issues by micro-batch, each batch written once however often it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.operators.normalize import issue_rows, normalize
from chainspark.sinks.store import cut
from chainspark.sources import records
from chainspark.sources import splits as S

OnEvents = Callable[[DataFrame, int], None]


def read_lines(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of ``file, start, value``: lines of new files under ``path`` with the split they stand in."""
    read = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    return read.select(*S.place(), "value")


def ingest(out: str, on_events: OnEvents | None = None, scenario_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of ``read_lines``: canonical events and issues, one folder a batch under ``out``.

    A record without an id is told by its file, line and text, so a batch gives the ids that a scan of
    the same files gives, also when it runs again after a failure; its folders are then written over.
    ``on_events`` takes the typed events of the batch, for instance ``ChainStore.add``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # One read of the batch's files; numbering and every write go by the same rows.
        lines = cut(S.placed(batch))
        found, bad = records.line_records(S.numbered(lines, S.count_splits(lines)))
        told = cut(normalize(found, scenario_id).join(S.small(cut(found.select("idx", "file", "line"))), "idx"))
        typed = told.where("event_type is not null").drop("issues")
        typed.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        own = issue_rows(told).join(told.select("idx", "file", "line"), "idx").select("file", "line", "scope", "field", "message")
        lost = bad.select("file", "line", F.lit("record").alias("scope"), F.lit("record").alias("field"), "message")
        own.unionByName(lost).write.mode("overwrite").parquet(f"{out}/issues/batch={batch_id}")
        if on_events:
            on_events(typed, batch_id)

    return run


def read_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/events").parquet(f"{out}/events")


def read_issues(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/issues").parquet(f"{out}/issues")
