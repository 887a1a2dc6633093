"""Indicator feeds: CSV, STIX and JSON files to one table, validation, matching against events, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of indicator types, and of the columns of CSV feeds.
TYPE_ALIASES = {
    "ip": "ip", "ipv4": "ip", "ipv6": "ip", "ip-address": "ip", "ip_address": "ip", "address": "ip", "src_ip": "ip", "dst_ip": "ip",
    "domain": "domain", "domain_name": "domain", "domain-name": "domain", "hostname": "domain", "dns": "domain",
    "hash": "hash", "md5": "hash", "sha1": "hash", "sha256": "hash", "file_hash": "hash", "file-hash": "hash", "checksum": "hash",
}
TYPE_COLUMNS = ("type", "kind", "indicator_type", "ioc_type")
VALUE_COLUMNS = ("value", "indicator", "ioc", "observable", "artifact", "data")
SOURCE_COLUMNS = ("source", "list", "provider", "feed", "dataset")
# Fixed value: a comparison in a STIX pattern.
COMPARISON = r"""([A-Za-z0-9_.\-:'"]+?)\s*=\s*'([^']+)'"""
CELLS = 12
FEED = ("file", "idx", "type", "value", "source")


def infer_type(value: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"
    return (
        F.when(value.rlike(rf"^{octet}(\.{octet}){{3}}$"), "ip")
        .when(value.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip")
        .when(value.rlike(r"^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), "hash")
        .when(value.rlike(r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"), "domain")
    )


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``FEED``) of all feed files under ``path`` and issues (``file, idx, field, message``) of what cannot be read."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return parse_feeds(files)


def parse_feeds(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_feeds``, from a table ``file, text``: a leading brace or bracket means JSON or STIX, else CSV."""
    nested = F.ltrim("text").rlike(r"^[{\[]")
    csv, csv_issues = _csv(files.where(~nested))
    json, json_issues = _json(files.where(nested))
    return csv.unionByName(json), csv_issues.unionByName(json_issues)


def _place(header: str, names: tuple[str, ...]) -> Column:
    """Where the first of the names stands in the header, from one; 0 where none does."""
    return F.coalesce(F.array_position(F.transform(header, lambda h: h.isin(*names)), True), F.lit(0)).cast("int")


def _csv(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = lambda line: F.array(*[F.from_csv(line, ", ".join(f"c{i} string" for i in range(CELLS)), {"escape": '"'})[f"c{i}"] for i in range(CELLS)])
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(F.translate(x, ",", " ")) != "")
    rows = files.select("file", lines.alias("lines"))
    rows = rows.withColumn("header", F.transform(cells(F.get("lines", 0)), lambda c: F.lower(F.trim(c))))
    rows = rows.withColumns({c: _place("header", names) for c, names in (("type_at", TYPE_COLUMNS), ("value_at", VALUE_COLUMNS), ("source_at", SOURCE_COLUMNS))})
    bare = (F.col("type_at") == 0) & (F.col("value_at") == 0)
    told = ~bare & (F.col("value_at") == 0)
    empty = F.size("lines") == 0
    issue = lambda field, message: (F.lit(None).cast("int").alias("idx"), F.lit(field).alias("field"), F.lit(message).alias("message"))
    issues = rows.where(empty).select("file", *issue("file", "file is empty")).unionByName(rows.where(told & ~empty).select("file", *issue("header", "no value column")))
    read = rows.where(~told & ~empty).select("file", "type_at", "source_at", F.when(bare, 1).otherwise(F.col("value_at")).alias("value_at"), bare.alias("bare"), F.posexplode("lines").alias("pos", "line"))
    read = read.where(F.col("bare") | (F.col("pos") > 0)).withColumn("cells", cells(F.col("line")))
    at = lambda c: F.when(F.col(c) > 0, F.get("cells", F.col(c) - 1))
    second = F.trim(F.get("cells", 1))
    beside = (F.col("type_at") == 0) & (F.col("source_at") == 0) & (F.col("value_at") == 1) & (second != "") & infer_type(second).isNull()
    source = F.coalesce(F.when(F.trim(at("source_at")) != "", F.trim(at("source_at"))), F.when(beside, second), F.col("file"))
    return read.select("file", (F.col("pos") + 1).alias("idx"), at("type_at").alias("type"), at("value_at").alias("value"), source.alias("source")), issues


def _json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    rows = files.withColumn("v", F.try_parse_json("text"))
    bundle = get("v", "$.objects", "array<variant>")
    listed = F.coalesce(get("v", "$.indicators", "array<variant>"), get("v", "$", "array<variant>"))
    plain = F.exists(listed, lambda x: F.coalesce(get(x, "$.value"), get(x, "$.indicator"), get(x, "$.observable"), get(x, "$")).isNotNull() & get(x, "$.pattern").isNull())
    rows = rows.withColumns({"objects": F.coalesce(bundle, F.when(~plain, listed)), "items": F.when(plain, listed), "given": F.coalesce(get("v", "$.source"), F.lit("json"))})
    item = rows.select("file", "given", F.posexplode("items").alias("idx", "x"))
    value = F.coalesce(get("x", "$.value"), get("x", "$.indicator"), get("x", "$.observable"), get("x", "$"))
    items = item.select("file", F.col("idx"), F.coalesce(get("x", "$.type"), get("x", "$.indicator_type")).alias("type"), value.alias("value"), F.coalesce(get("x", "$.source"), F.col("given")).alias("source"))
    stix = rows.select("file", F.posexplode("objects").alias("idx", "x")).where(get("x", "$.type") == "indicator")
    stix = stix.select("file", "idx", F.coalesce(get("x", "$.pattern"), F.lit("")).alias("pattern"), F.substring(F.coalesce(get("x", "$.source"), get("x", "$.name"), F.lit("stix")), 1, 120).alias("source"))
    pairs = F.arrays_zip(F.regexp_extract_all("pattern", F.lit(COMPARISON), F.lit(1)).alias("k"), F.regexp_extract_all("pattern", F.lit(COMPARISON), F.lit(2)).alias("value"))
    key = F.lower(F.btrim("k", F.lit("'\"")))
    kind = F.when(key.contains("ipv4") | key.contains("ipv6"), "ip").when(key.contains("domain"), "domain").when(key.contains("hashes") | key.startswith("file:"), "hash")
    named = stix.select("file", "idx", "source", F.inline(pairs)).select("file", "idx", kind.alias("type"), "value", "source")
    issue = lambda df, idx, field, message: df.select("file", idx.cast("int").alias("idx"), F.lit(field).alias("field"), F.lit(message).alias("message"))
    issues = issue(rows.where(F.col("v").isNull()), F.lit(None), "file", "not valid JSON")
    neither = rows.where(F.col("v").isNotNull() & F.coalesce("objects", "items").isNull())
    issues = issues.unionByName(issue(neither, F.lit(None), "file", "neither a bundle nor a list"))
    issues = issues.unionByName(issue(stix.where("pattern = ''"), F.col("idx"), "pattern", "no pattern"))
    issues = issues.unionByName(issue(stix.where((F.col("pattern") != "") & (F.size(pairs) == 0)), F.col("idx"), "pattern", "no value in the pattern"))
    return items.unionByName(named), issues


def _sound(feed: DataFrame) -> DataFrame:
    value = F.btrim(F.trim("value"), F.lit("'\""))
    named = F.element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPE_ALIASES.items()) + ")"), F.coalesce(F.lower(F.trim("type")), F.lit("")))
    file = F.col("file") if "file" in feed.columns else F.lit(None).cast("string").alias("file")
    rows = feed.select(file, "idx", F.coalesce(named, infer_type(value)).alias("type"), F.coalesce(value, F.lit("")).alias("value"), F.coalesce("source", F.lit("import")).alias("source"))
    return rows.withColumn("key", F.when(F.col("type") == "ip", F.col("value")).otherwise(F.lower("value")))


def indicators(feed: DataFrame) -> DataFrame:
    """``type, value, key, source`` of a feed (``idx, type, value, source``): a known declared type is trusted, others inferred; one row a key and source."""
    rows = _sound(feed).where("value <> '' and type is not null")
    return rows.groupBy("type", "key", "source").agg(F.min("idx").alias("idx"), F.min_by("value", "idx").alias("value"))


def feed_issues(feed: DataFrame) -> DataFrame:
    """``file, idx, field, message``: rows that are empty, of no type that can be told, or repeated in their feed."""
    rows = _sound(feed)
    issue = lambda df, message: df.select("file", F.col("idx").cast("int").alias("idx"), F.lit("value").alias("field"), F.lit(message).alias("message"))
    valid = rows.where("value <> '' and type is not null")
    first = valid.groupBy("type", "key", "source").agg(F.min(F.struct("file", "idx")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = valid.join(first, ["type", "key", "source"]).where(F.struct("file", "idx") != F.col("first"))
    out = issue(rows.where("value = ''"), "empty value").unionByName(issue(rows.where("value <> '' and type is null"), "type cannot be told"))
    return out.unionByName(issue(again, "repeated"))


def match(events: DataFrame, listed: DataFrame) -> DataFrame:
    """``event_id, field, type, value, source, severity``: the last source of a value wins.

    The indicator side is shuffled or broadcast as Spark finds its size; nothing is forced.
    """
    last = listed.groupBy("type", "key").agg(F.max_by("source", "idx").alias("source"))
    fields = [("source_ip", "ip"), ("destination_ip", "ip"), ("domain", "domain")] + ([("file_hash", "hash")] if "file_hash" in events.columns else [])
    spread = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.col(f).alias("value")) for f, t in fields])
    rows = events.select("event_id", F.explode(F.filter(spread, lambda x: x["value"].isNotNull())).alias("x")).select("event_id", "x.*")
    rows = rows.withColumn("key", F.when(F.col("type") == "ip", F.col("value")).otherwise(F.lower("value")))
    severity = F.when(F.col("type") == "hash", "HIGH").otherwise("MEDIUM").alias("severity")
    return rows.join(last, ["type", "key"]).select("event_id", "field", "type", "value", "source", severity)


def new_matches(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Matches that are not stored yet: one an event, value and source, without those of ``known``."""
    key = ["event_id", "value", "source"]
    return matches.groupBy(*key).agg(F.min(F.struct("field", "type", "severity")).alias("m")).select(*key, "m.*").join(known.select(*key), key, "left_anti")


def as_detections(matches: DataFrame) -> DataFrame:
    """Matches as rows of detections, without technique or tactic."""
    null = F.lit(None).cast("string")
    return matches.select(
        "event_id", F.lit(18).alias("rule_ord"), F.lit("IOC_MATCH").alias("rule_id"), "severity", null.alias("technique_id"),
        F.concat(F.lit("Indicator seen: "), F.col("value")).alias("title"),
        F.array(F.struct(F.col("field").alias("field"), F.col("value").alias("value"), F.concat(F.lit("listed by "), F.col("source")).alias("why"))).alias("evidence"),
        null.alias("technique_name"), null.alias("tactic"),
    )


def chain_matches(matches: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """``chain, event_id, summary``: a match for every chain of its event, without those of ``known``."""
    summary = F.concat_ws(" ", F.lit("indicator"), "type", "value", F.lit("of"), "source").alias("summary")
    rows = matches.join(members.select("chain", "event_id"), "event_id").select("chain", "event_id", summary).distinct()
    return rows.join(known, ["chain", "event_id", "summary"], "left_anti")


def import_report(listed: DataFrame, matches: DataFrame, fresh: DataFrame) -> DataFrame:
    """``type, indicators, matches, created, duplicates`` by type."""
    per = lambda df, name: df.groupBy("type").agg(F.count(F.lit(1)).alias(name))
    out = per(listed, "indicators").join(per(matches, "matches"), "type", "left").join(per(fresh, "created"), "type", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("matches", "created")}
    return out.withColumns(zero).withColumn("duplicates", F.col("matches") - F.col("created"))
