"""Sinks: exports, event tables without duplicates, dataset replacement, chain tables and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.sinks.store import cut


def export_json(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """JSON arrays of about ``per_file`` records (``idx, raw``) each, one file an array, in order within it."""
    part = F.floor(F.col("idx") / per_file)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "raw"))), lambda x: x["raw"])
    write_texts(records.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(ordered, ",\n"), F.lit("]")).alias("value")), path)


#: Files of one folder; a folder for each file makes listing as dear as reading.
PER_FOLDER = 100


def write_texts(texts: DataFrame, path: str) -> None:
    """Text files, one a row of ``texts`` (``part``, a number, and ``value``), whose paths are in the order of ``part``."""
    # Of equal length as text, and no text itself: the writer would sort texts anew.
    folder = (F.lit(10**15) + F.floor(F.col("part") / PER_FOLDER)).alias("folder")
    dealt = texts.select(folder, "part", "value").repartition("folder").sortWithinPartitions("folder", "part")
    dealt.select("folder", "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def union_of_keys(records: DataFrame) -> list[str]:
    """Keys of all records in the order of their first record, then of their place in it."""
    keys = records.select("idx", F.posexplode(F.map_keys(F.from_json("raw", "map<string,string>"))).alias("place", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("idx", "place")).alias("at"))
    return [r["key"] for r in first.orderBy("at").collect()]


def export_csv(records: DataFrame, path: str) -> None:
    """CSV files with one header, the union of all keys; missing values are empty."""
    m = F.from_json("raw", "map<string,string>")
    cells = [F.element_at("m", F.lit(k)).alias(k) for k in union_of_keys(records)]
    records.select(m.alias("m")).select(*cells).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def first_of_batch(batch: DataFrame) -> DataFrame:
    """One row an ``event_id``: the first by place."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("idx"))
    return batch.withColumn("_place", place).where("_place = 1").drop("_place")


def add_events(stored: DataFrame, batch: DataFrame, replace_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored table with a batch added, and counts ``received, stored, duplicates``.

    An id that is stored or stands earlier in the batch is a duplicate; with ``replace_duplicates`` the
    batch's first row takes the place of the stored one.  The same batch twice changes nothing.
    """
    first = cut(first_of_batch(batch))
    new = first.join(stored.select("event_id"), "event_id", "left_anti")
    if replace_duplicates:
        table = stored.join(first.select("event_id"), "event_id", "left_anti").unionByName(first, allowMissingColumns=True)
    else:
        table = stored.unionByName(new, allowMissingColumns=True)
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    counts = stored.sparkSession.range(1).select(n(batch).alias("received"), n(new).alias("stored"))
    return table, counts.withColumn("duplicates", F.col("received") - F.col("stored"))


def without_dataset(tables: dict[str, DataFrame], dataset_id: str | None = None, scenarios: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables without the events of a dataset or of scenarios, and without what hangs on them.

    ``events`` names the events; every other table with ``event_id`` loses their rows, and tables by
    ``chain`` lose the chains that held one.
    """
    gone = F.lit(False)
    if dataset_id is not None:
        gone = gone | F.coalesce(F.element_at("metadata", F.lit("dataset_id")) == dataset_id, F.lit(False))
    if scenarios:
        gone = gone | F.coalesce(F.col("scenario_id").isin(*scenarios), F.lit(False))
    events = tables["events"]
    ids = events.where(gone).select("event_id")
    out = {"events": events.where(~gone)}
    chains = tables["members"].join(ids, "event_id", "left_semi").select("chain").distinct() if "members" in tables else None
    for name, df in tables.items():
        if name != "events":
            if chains is not None and "chain" in df.columns:
                df = df.join(chains, "chain", "left_anti")
            elif "event_id" in df.columns:
                df = df.join(ids, "event_id", "left_anti")
            out[name] = df
    return out


def write_chains(path: str, chains: DataFrame, members: DataFrame, evidence: DataFrame) -> None:
    """Derived tables, written anew each time."""
    for name, df in (("chains", chains), ("members", members), ("evidence", evidence)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_run(path: str, run: DataFrame) -> None:
    run.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
