"""CSV files as they come: each by its own header and separator, quoted line breaks kept.

A line's effect on the quotes is a small function: is a quoted field open behind it, if none was
before it, and if one was?  Functions compose, so every split gives its own and the files' order of
splits tells each split how it begins.  Files in which no line leaves a field open need none of
this: there each line is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.sinks.store import cut
from chainspark.sources import splits as S

# The separators that are looked for.
SEPARATORS = (",", ";", "\t", "|")
#: Lines of one record; a quoted field that runs on for more is reported and not read.
RECORD_LINES = 10_000
FILLED = r"\S"


def leaves_open(value: Column, separator: str, open_before: bool) -> Column:
    """1 if a quoted field is open behind the line, by whether one was open before it.

    A quote opens a field only at its start, and two in a row inside one are a character.
    """
    step = lambda state, piece: F.struct(
        F.when(state["quoted"] == 1, 2)
        .when((state["quoted"] == 2) & (state["last"] == ""), 1)
        .when(state["last"].endswith(separator) | ((state["last"] == "") & state["fresh"]), 1)
        .otherwise(0)
        .alias("quoted"),
        piece.alias("last"),
        F.lit(False).alias("fresh"),
    )
    parts = F.split(value, '"')
    start = F.struct(F.lit(int(open_before)).alias("quoted"), F.get(parts, F.lit(0)).alias("last"), F.lit(not open_before).alias("fresh"))
    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda s: (s["quoted"] == 1).cast("int"))
    return F.when(F.contains(value, F.lit('"')), walked).otherwise(int(open_before))


def by_separator(f) -> Column:
    """``f(separator)`` for the row's own separator, in column ``sep``."""
    out = F.lit(None)
    for s in SEPARATORS:
        out = F.when(F.col("sep") == s, f(s)).otherwise(out)
    return out


def sniffed(header: Column) -> Column:
    """The separator that stands most often in a header; the first of equals."""
    n = F.array(*[F.struct(F.regexp_count(header, F.lit(f"[{s}]")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
    return F.array_max(n)["s"]


def whole_records(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (``file, line, idx, value``) of lines with ``sep`` in files with quoted line breaks, and issues of fields that never end."""
    closed, opened = (by_separator(lambda s, o=o: leaves_open(F.col("value"), s, o)) for o in (False, True))
    told = read.withColumns({"closed": closed, "opened": opened})
    by_split = Window.partitionBy("file", "start").orderBy("at")
    upto, before = by_split.rowsBetween(Window.unboundedPreceding, 0), by_split.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("closed") == F.col("opened"), (F.col("closed") > F.col("opened")).cast("int")
    # What the lines so far make of the state: the last one that fixes it, and turns since.
    told = told.withColumn("turned", F.sum(turns).over(upto))
    set_by = F.when(fixed, F.struct(F.col("closed").alias("to"), F.col("turned").alias("at_turn")))
    for name, window in (("mine", upto), ("prior", before)):
        told = told.withColumn(name, F.last(set_by, ignorenulls=True).over(window))
    told = cut(told.withColumn("turned_before", F.col("turned") - turns).drop("closed", "opened"))
    # lambda entry: state behind a prefix of a split that begins with ``entry``
    after = lambda last, turned, entry: (F.coalesce(last["to"], entry) + F.coalesce(turned - last["at_turn"], turned)) % 2
    ends = told.groupBy("file", "start").agg(F.max_by(F.struct("mine", "turned"), "at").alias("end"))
    chain = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("run"))
    first = F.struct(F.lit(0).cast("long").alias("state"), F.array().cast("array<struct<start:bigint,entry:bigint>>").alias("entries"))
    step = lambda acc, x: F.struct(
        after(x["end"]["mine"], x["end"]["turned"], acc["state"]).cast("long").alias("state"),
        F.array_append(acc["entries"], F.struct(x["start"].alias("start"), acc["state"].alias("entry"))).alias("entries"),
    )
    entries = chain.select("file", F.inline(F.aggregate("run", first, step, lambda a: a["entries"])))
    told = told.join(S.small(cut(entries)), ["file", "start"])
    told = S.since(told, after(F.col("prior"), F.col("turned_before"), F.col("entry")) == 0)
    long = cut(told.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RECORD_LINES))
    kept = told.join(long, ["file", "record"], "left_anti")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), "\n")
    records = kept.groupBy("file", "record").agg(F.min("line").alias("line"), joined.alias("value")).withColumnRenamed("record", "idx")
    return records.select("file", "line", "idx", "value"), long.select("file", F.col("record").alias("idx"), F.lit("quoted field does not end").alias("message"))


def scan_csv(spark: SparkSession, path: str, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (``file, line, idx, raw``) of CSV files with headers, and issues (``file, idx, message``).

    Every file is read by its own header and (unless given) its own separator.  Names are trimmed; empty
    cells, blank rows and cells without a name are left out; of equal names the last counts.  A file without
    text, without a header or without rows is an issue (Spark does not list files of no bytes; if there are no others, it is
    an error).  ``line`` and ``idx`` say where a record begins
    in its file and over all files.
    """
    there = S.listed(spark, path).select("file")
    if there.isEmpty():
        raise ValueError(f"no CSV file with content under {path}")
    return _scan(S.lines(spark, path), there, separator)


def scan_csv_texts(texts: DataFrame, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``scan_csv`` of files that a stored table holds whole, one row (``file, value``) each.

    For very many tiny files: on disk each costs a listing and a reader in every pass, in a table it is a row.
    """
    return _scan(S.text_lines(texts), texts.select("file"), separator)


def _scan(read: DataFrame, there: DataFrame, separator: str | None) -> tuple[DataFrame, DataFrame]:
    """``scan_csv`` of numbered ``lines`` and the files they are of."""
    if separator is not None and separator not in SEPARATORS:
        raise ValueError(f"separator {separator!r} is none of {SEPARATORS}")
    left_open = {f"open_{i}": leaves_open(F.col("value"), s, False) for i, s in enumerate(SEPARATORS)}
    counted = S.count_splits(read, **left_open, filled=F.col("value").rlike(FILLED).cast("int"))
    rows = S.numbered(read, counted).withColumn("value", F.when(F.col("line") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    sep = F.lit(separator) if separator else sniffed(F.col("value"))
    sums = counted.groupBy("file").agg(F.sum("filled").alias("filled"), *[F.sum(c).alias(c) for c in left_open])
    heads = rows.where("line = 0").select("file", F.col("value").alias("header"), sep.alias("sep"))
    files = there.join(sums, "file", "left").join(heads, "file", "left")
    is_open = by_separator(lambda s: F.col(f"open_{SEPARATORS.index(s)}")) > 0
    files = cut(files.select("file", "sep", "header", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce(is_open, F.lit(False)).alias("broken")))
    issue = lambda where, text: files.where(where).select("file", F.lit(None).cast("long").alias("idx"), F.lit(text).alias("message"))
    headed = (F.col("filled") > 0) & F.col("header").rlike(FILLED)
    issues = issue(F.col("filled") == 0, "empty CSV content").unionByName(issue((F.col("filled") > 0) & ~F.col("header").rlike(FILLED), "CSV has no header row"))
    told = rows.join(S.small(files.where(headed).select("file", "sep", "broken")), "file")
    whole = told.where(~F.col("broken")).select("file", "line", "idx", "value", "sep")
    if not files.where("broken").isEmpty():
        found, more = whole_records(told.where("broken"))
        issues = issues.unionByName(more)
        whole = whole.unionByName(found.join(S.small(files.where(headed).select("file", "sep")), "file"))
    heads = cut(whole.where("line = 0").select("file", F.col("value").alias("header"), "sep"))
    width = heads.agg(F.max(by_separator(lambda s: F.regexp_count("header", F.lit(f"[{s}]"))))).first()[0]
    schema = ", ".join(f"c{i} string" for i in range((width or 0) + 1))

    def cells(of: str) -> Column:
        parsed = by_separator(lambda s: F.from_csv(F.col(of), F.lit(schema), {"sep": s, "escape": '"', "maxColumns": str((width or 0) + 20480)}))
        return F.array(*[parsed[f"c{i}"] for i in range((width or 0) + 1)])

    names = F.transform(cells("header"), lambda x: F.coalesce(F.trim(x, F.lit(" \t\r\n")), F.lit("")))
    keys = S.small(cut(heads.select("file", names.alias("names"))))
    table = whole.where(F.col("line") > 0).where(F.col("value").rlike(FILLED)).withColumn("cells", cells("value")).join(keys, "file")
    pairs = F.filter(F.arrays_zip(F.col("names").alias("k"), F.slice("cells", 1, F.size("names")).alias("v")), lambda p: (p["k"] != "") & p["v"].rlike(FILLED))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size("names")), lambda q: q["k"] == p["k"]))
    made = table.select("file", "line", "idx", F.map_from_entries(last).alias("m")).where(F.size("m") > 0)
    with_rows = made.select("file").distinct()
    none = files.where(headed).join(with_rows, "file", "left_anti")
    issues = issues.unionByName(none.select("file", F.lit(None).cast("long").alias("idx"), F.lit("CSV contains no data rows").alias("message")))
    return made.select("file", "line", "idx", F.to_json("m").alias("raw")), issues
