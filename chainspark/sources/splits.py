"""Lines of text files in their own order, however Spark splits the files over tasks.

A first pass counts the lines of every split (one small row a split); sums over the splits before
then number each line within its file and over all files, without moving a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.sinks.store import cut

#: Rows of a table of splits or files (a path and a few numbers each) that may be broadcast; beyond it Spark joins as it sees fit.
BROADCAST_ROWS = 100_000
_SPLIT = ["file", "start", "task"]


def place() -> list[Column]:
    """File and first byte of the split that a line stands in."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]


def small(df: DataFrame) -> DataFrame:
    """A cut table as a broadcast side if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, task, at, value``: lines of the files under ``path``, with the byte where their split begins and their order in their task."""
    return placed(spark.read.text(path).select(*place(), "value"))


def text_lines(texts: DataFrame) -> DataFrame:
    """``lines`` of files that a table holds whole, one row (``file, value``) each."""
    parts = F.split("value", "\r\n|\r|\n")
    # What ends with a line break has no line behind it.
    ended = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return placed(texts.select("file", F.lit(0).cast("long").alias("start"), F.explode(ended).alias("value")))


def placed(read: DataFrame) -> DataFrame:
    """``file, start, value`` with the order of each line in its task."""
    return read.select("file", "start", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "value")


def count_splits(read: DataFrame, **more: Column) -> DataFrame:
    """One row a split of ``lines``: its first order number, its lines, the lines before it in its file and in all; ``more`` are sums."""
    one = read.groupBy(*_SPLIT).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in more.items()])
    own = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    return cut(one.withColumns({"before": before(own), "before_all": before(every)}))


def numbered(read: DataFrame, splits: DataFrame) -> DataFrame:
    """``lines`` with ``line`` (from 0 in its file) and ``idx`` (from 0 over all files in order of their path).

    Files must stay as they were counted; a split that was not is an error.
    """
    told = read.join(small(splits.select(*_SPLIT, "low", "before", "before_all")), _SPLIT, "left")
    low = F.coalesce("low", F.raise_error(F.lit("files changed between counting and reading")).cast("long"))
    return told.select("file", "start", "at", (F.col("at") - low + F.col("before")).alias("line"), (F.col("at") - low + F.col("before_all")).alias("idx"), "value")


def since(rows: DataFrame, begins: Column) -> DataFrame:
    """Numbered lines with ``record``: ``idx`` of the last line at or before it for which ``begins`` holds, null before the file's first.

    Lines meet only those of their own split; what an earlier split began is carried over by one small row a split.
    """
    own = F.last(F.when(begins, F.col("idx")), ignorenulls=True).over(Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    most = rows.groupBy("file", "start").agg(F.max(F.when(begins, F.col("idx"))).alias("most"))
    carried = F.last("most", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    earlier = small(cut(most.select("file", "start", carried.alias("carried"))))
    return rows.withColumn("own", own).join(earlier, ["file", "start"]).withColumn("record", F.coalesce("own", "carried")).drop("own", "carried")


def running(rows: DataFrame, value: Column, name: str, order: str = "at") -> DataFrame:
    """``rows`` (``file, start`` and an order in the split) with the sum of ``value`` over all earlier rows of the file."""
    before = Window.partitionBy("file", "start").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "start").agg(F.sum(value).alias("sum"))
    carried = F.sum("sum").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    earlier = small(cut(splits.select("file", "start", F.coalesce(carried, F.lit(0)).alias("carried"))))
    inside = F.coalesce(F.sum(value).over(before), F.lit(0))
    return rows.withColumn(name, inside).join(earlier, ["file", "start"]).withColumn(name, F.col(name) + F.col("carried")).drop("carried")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, rank``: files under ``path`` in order; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    return cut(files.withColumn("rank", F.row_number().over(Window.orderBy("file")) - 1))
