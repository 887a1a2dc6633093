"""Scans of JSON telemetry files to raw records and issues; ``csv_files`` has those of CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.sinks.store import cut
from chainspark.sources import splits as S

#: Bytes of a JSON file up to which one task reads it whole.
WHOLE_BYTES = 64 << 20

# Keys under which a JSON object may hold its list of records, and keys that mark one record.
LIST_KEYS = ("events", "records", "data", "items", "telemetry", "logs")
RECORD_KEYS = ("event_type", "type", "timestamp", "EventID", "computer")


def parse_json_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, idx, raw`` of texts (``file, value``) that hold a list, an object with a list, or one record; issues for the rest.

    ``idx`` counts within the text.  Records keep their own key order.
    """
    bare = texts.select("file", F.regexp_replace("value", "^﻿", "").alias("value"))
    whole = F.from_json("value", "map<string,variant>")
    as_list = F.from_json("value", "array<variant>")
    # Keys of the object in its own order; items as text in theirs.
    fields = bare.select("file", "value", F.when(F.ltrim("value").startswith("{"), whole).alias("m"), F.when(F.ltrim("value").startswith("["), as_list).alias("l"))
    inner = F.coalesce(*[F.try_variant_get(F.element_at("m", F.lit(k)), "$", "array<variant>") for k in LIST_KEYS])
    single = F.arrays_overlap(F.map_keys("m"), F.array(*[F.lit(k) for k in RECORD_KEYS]))
    items = F.transform(F.coalesce("l", inner), lambda v: F.to_json(v))
    found = fields.select("file", F.coalesce(items, F.when(single, F.array("value"))).alias("items"), (F.col("m").isNull() & F.col("l").isNull()).alias("broken"))
    rows = found.select("file", F.posexplode("items").alias("idx", "raw")).withColumn("idx", F.col("idx").cast("long"))
    bad = found.where("items is null")
    message = F.when(F.col("broken"), "not valid JSON, or no list and no object").otherwise("object without a list of records")
    return rows, bad.select("file", F.lit(None).cast("long").alias("idx"), message.alias("message"))


def scan_json(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records (``file, line, idx, raw``) and issues of JSON files.

    A file of up to ``whole`` bytes is read by one task; a larger one is an array whose items are cut
    out wherever its splits lie.  ``line`` counts in the file; ``idx`` keeps the order of files and of
    records in them, with gaps.
    """
    size = F.col("_metadata.file_size")
    texts = spark.read.text(path, wholetext=True).where(size <= whole).select(F.col("_metadata.file_path").alias("file"), "value")
    rows, issues = parse_json_texts(texts)
    rows = rows.select("file", F.col("idx").alias("line"), "raw")
    files = S.listed(spark, path)
    if not files.where(F.col("length") > whole).isEmpty():
        found, bad = array_items(spark.read.option("lineSep", "}").text(path).where(size > whole).select(*S.place(), "value"))
        rows, issues = rows.unionByName(found), issues.unionByName(bad)
    ranks = S.small(files.select("file", "rank"))
    return rows.join(ranks, "file").select("file", "line", (F.shiftleft(F.col("rank").cast("long"), 40) + F.col("line")).alias("idx"), "raw"), issues


def array_items(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (``file, line, raw``) of files that hold one JSON array each, and issues; ``pieces`` are their texts cut at every ``}``.

    The quotes before a piece tell whether it begins inside a string, the brackets outside strings how deep.  Both
    are sums over the pieces before it, so splits only exchange theirs.  An item ends where a ``}`` leaves
    the array's own depth.
    """
    read = S.placed(pieces)
    counted = S.count_splits(read)
    last = S.small(cut(counted.groupBy("file").agg((F.sum("n") - 1).alias("last"))))
    rows = S.numbered(read, counted).join(last, "file")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"')))
    rows = S.running(rows.withColumn("odd", quotes % 2), F.col("odd"), "quotes").withColumn("inside", F.col("quotes") % 2 == 1)
    outside = F.when(F.col("inside"), F.regexp_replace(bare, r'(?s)^[^"]*("|\z)', "")).otherwise(bare)
    outside = F.regexp_replace(outside, r'(?s)"[^"]*("|\z)', "")
    closes = (F.col("line") < F.col("last")) & ((F.col("quotes") + F.col("odd")) % 2 == 0)
    depth = F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"\]")) - closes.cast("int")
    rows = S.running(rows.withColumn("step", depth).drop("odd", "quotes"), F.col("step"), "depth")
    rows = S.since(rows, (F.col("line") == 0) | ((F.col("depth") == 1) & ~F.col("inside")))
    ended = F.concat("value", F.when(F.col("line") < F.col("last"), "}").otherwise(""))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", ended.alias("text")))), lambda x: x["text"]), "")
    # A record's pieces lie side by side; its place is that of its first.
    one = rows.groupBy("file", "record").agg(F.min("start").alias("start"), F.min("line").alias("first"), F.max(F.col("line") == F.col("last")).alias("at_end"), parts.alias("text"))
    text = F.when(F.col("first") == 0, F.regexp_replace("text", r"(?s)^\ufeff?\s*\[", "")).otherwise(F.regexp_replace("text", r"(?s)^\s*,", ""))
    text = F.when(F.col("at_end"), F.regexp_replace(text, r"(?s)\]\s*\z", "")).otherwise(text)
    items = one.withColumn("items", F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>"))
    placed = S.running(items, F.coalesce(F.size("items"), F.lit(0)), "before", "record")
    found = placed.select("file", "before", F.posexplode("items").alias("pos", "item"))
    bad = items.where("items is null").select("file", F.lit(None).cast("long").alias("idx"), F.lit("not valid JSON, or no list").alias("message"))
    return found.select("file", (F.col("before") + F.col("pos")).alias("line"), F.to_json("item").alias("raw")), bad


def line_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (``file, line, idx, raw``) and issues of numbered lines that hold one JSON object each."""
    rows = rows.where(F.trim("value") != "").withColumnRenamed("value", "raw")
    sound = F.from_json("raw", "map<string,variant>").isNotNull()
    return rows.where(sound).select("file", "line", "idx", "raw"), rows.where(~sound).select("file", "line", "idx", F.lit("line is no JSON object").alias("message"))


def scan_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and issues of files with one JSON object a line, numbered as they stand in files and over all files."""
    read = S.lines(spark, path)
    return line_records(S.numbered(read, S.count_splits(read)))
