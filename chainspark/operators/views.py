"""Investigation views and roll-ups over events, detections and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.dims import STAGES, TACTICS, TECHNIQUES, tactic_stage, tactics
from chainspark.operators.entities import event_entities

STATUSES = ("NEW", "INVESTIGATING", "CONFIRMED", "FALSE_POSITIVE", "CLOSED")
#: What to do next, by the tactics seen.
ADVICE = (
    (("CREDENTIAL ACCESS", "PRIVILEGE ESCALATION"), "reset the accounts and read their logons"),
    (("PERSISTENCE",), "check autostart keys, services and tasks"),
    (("COMMAND AND CONTROL",), "block the destinations and look for beacons"),
    (("LATERAL MOVEMENT",), "isolate the hosts and read remote service use"),
)
ALWAYS = ("confirm each finding in the raw records", "hold the path against the coverage of techniques")


def event_detail(events: DataFrame, detections: DataFrame, members: DataFrame) -> DataFrame:
    """``event_id``, its fields, and lists of its findings, entities and chain."""
    found = detections.groupBy("event_id").agg(F.sort_array(F.collect_list("rule_id")).alias("rules"))
    things = event_entities(events).groupBy("event_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "entity_type", "value", "role"))).alias("entities"))
    out = events.join(found, "event_id", "left").join(things, "event_id", "left").join(members.select("event_id", "chain", "position"), "event_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("rules", "entities")})


def report(chains: DataFrame, detections: DataFrame, steps: DataFrame) -> DataFrame:
    """``chain, story, findings, advice``: sentences, the first six findings by severity name, and next steps."""
    none = F.array().cast("array<string>")
    first = F.slice(F.sort_array(F.collect_list(F.struct("severity", (-F.col("position")).alias("p"), (-F.col("rule_ord")).alias("r"), "title")), asc=False), 1, 6)
    found = detections.groupBy("chain").agg(F.transform(first, lambda x: F.concat(x["severity"], F.lit(": "), x["title"])).alias("findings"))
    gaps = steps.groupBy("chain").agg(F.sort_array(F.collect_set("technique_id")).alias("gaps"))
    rows = chains.join(found, "chain", "left").join(gaps, "chain", "left")
    listed = lambda words, c: F.when(F.size(c) > 0, F.concat(F.lit(words), F.array_join(c, ", ")))
    story = F.array_compact(
        F.array(
            F.concat(F.col("events").cast("string"), F.lit(" events of "), F.size("hosts").cast("string"), F.lit(" hosts and "), F.size("users").cast("string"), F.lit(" accounts")),
            F.when(F.size("tactics") > 0, F.concat(F.lit("tactics: "), F.array_join("tactics", " -> "))),
            F.when(F.size("techniques") > 0, F.concat(F.lit("techniques: "), F.array_join(F.slice("techniques", 1, 6), ", "))),
            listed("possible gaps: ", "gaps"),
        )
    )
    scores = F.array(
        F.concat(F.lit("confidence "), F.format_string("%.1f", "confidence")),
        F.concat_ws(" ", F.lit("risk"), "risk_level", F.col("risk").cast("string")),
    )
    seen = lambda names: F.arrays_overlap("tactics", F.array(*[F.lit(n) for n in names]))
    advice = F.concat(F.array_compact(F.array(*[F.when(seen(names), F.lit(words)) for names, words in ADVICE])), F.array(*[F.lit(x) for x in ALWAYS]))
    return rows.select("chain", story.alias("story"), F.concat(F.coalesce("findings", none), scores).alias("findings"), advice.alias("advice"))


def apply_feedback(chains: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains with the status of their latest valid entry (``NEW`` without one) and history, newest first; and the refused entries.

    ``log`` is ``chain, at, status, comment``; a status must be known, a comment keeps 4000 characters.
    """
    status = F.upper(F.trim("status"))
    valid = log.where(status.isin(*STATUSES)).withColumns({"status": status, "comment": F.substring("comment", 1, 4000)})
    entry = F.struct("at", "status", "comment")
    seen = valid.groupBy("chain").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.sort_array(F.collect_list(entry), asc=False).alias("history"))
    out = chains.join(seen, "chain", "left").withColumn("status", F.coalesce("status", F.lit("NEW")))
    return out, log.where(~F.coalesce(status.isin(*STATUSES), F.lit(False)))


def technique_chains(chains: DataFrame) -> DataFrame:
    """``technique_id, chains``: the chains that contain each technique."""
    return chains.select("chain", F.explode("techniques").alias("technique_id")).groupBy("technique_id").agg(F.sort_array(F.collect_set("chain")).alias("chains"))


def coverage(chains: DataFrame) -> DataFrame:
    """``tactic, idx, techniques, n_chains``: catalog techniques seen in chains, by tactic in order, and those not in the catalog as ``UNKNOWN``."""
    catalog = chains.sparkSession.createDataFrame([(t, tactic) for t, _, tactic in TECHNIQUES], "technique_id string, tactic string")
    seen = chains.select("chain", F.explode("techniques").alias("technique_id")).groupBy("technique_id").agg(F.countDistinct("chain").alias("in_chains"))
    named = seen.join(F.broadcast(catalog), "technique_id", "left").withColumn("tactic", F.coalesce("tactic", F.lit("UNKNOWN")))
    rows = named.groupBy("tactic").agg(F.array_join(F.sort_array(F.collect_set("technique_id")), ",").alias("techniques"), F.sum("in_chains").alias("n_chains"))
    order = tactics(chains.sparkSession).select("tactic", "idx").union(chains.sparkSession.createDataFrame([("UNKNOWN", 99)], "tactic string, idx int"))
    return F.broadcast(order).join(rows, "tactic", "left").select("tactic", "idx", F.coalesce("techniques", F.lit("")).alias("techniques"), F.coalesce("n_chains", F.lit(0)).cast("long").alias("n_chains"))


def tactic_sizes(found: DataFrame) -> DataFrame:
    """``tactic, idx, catalog, found``: techniques a tactic has in the catalog, and of them found by detections."""
    spark = found.sparkSession
    catalog = spark.createDataFrame([(t, tactic) for t, _, tactic in TECHNIQUES], "technique_id string, tactic string")
    seen = found.select("technique_id").distinct().withColumn("seen", F.lit(1))
    rows = catalog.join(seen, "technique_id", "left").groupBy("tactic").agg(F.count(F.lit(1)).alias("catalog"), F.count("seen").alias("found"))
    return tactics(spark).select("tactic", "idx").join(rows, "tactic", "left").select("tactic", "idx", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("catalog", "found")])


def kill_chain_bars(chains: DataFrame) -> DataFrame:
    """``stage, name, techniques``: distinct techniques of chains by the stage of their tactic."""
    spark = chains.sparkSession
    catalog = spark.createDataFrame([(t, tactic) for t, _, tactic in TECHNIQUES], "technique_id string, tactic string")
    seen = chains.select(F.explode("techniques").alias("technique_id")).distinct().join(F.broadcast(catalog), "technique_id")
    rows = seen.groupBy(tactic_stage(F.col("tactic")).alias("stage")).agg(F.count(F.lit(1)).alias("techniques"))
    names = spark.createDataFrame([(i + 1, n) for i, n in enumerate(STAGES)], "stage int, name string")
    return names.join(rows, "stage", "left").select("stage", "name", F.coalesce("techniques", F.lit(0)).cast("long").alias("techniques"))


def kill_chain_listing(detections: DataFrame) -> DataFrame:
    """``tactic, stage, stage_name, findings``: the map of tactics to stages, with the findings of each."""
    spark = detections.sparkSession
    found = detections.groupBy("tactic").agg(F.count(F.lit(1)).alias("findings"))
    table = spark.createDataFrame([(t, s, STAGES[s - 1]) for t, s in TACTICS], "tactic string, stage int, stage_name string")
    return table.join(found, "tactic", "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))


def counts(**tables: DataFrame) -> DataFrame:
    """``name, n``: rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def tally(df: DataFrame, **when: Column) -> DataFrame:
    """``name, n``: rows for which each condition holds, all counted in one pass."""
    row = df.agg(*[F.count_if(c).alias(name) for name, c in when.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in when])))


def by_value(df: DataFrame, label: str, **columns: str) -> DataFrame:
    """``label, name, n``: rows by each value of several columns, in one pass and one shuffle."""
    cells = F.array(*[F.struct(F.lit(what).alias(label), F.col(c).alias("name")) for what, c in columns.items()])
    return df.select(F.inline(cells)).groupBy(label, "name").agg(F.count(F.lit(1)).alias("n"))


def store_stats(events: DataFrame, chains: DataFrame) -> DataFrame:
    """``what, name, n``: events by severity, chains by risk level and by status."""
    return by_value(events, "what", severity="severity").unionByName(by_value(chains, "what", risk_level="risk_level", status="status"))


def run_counts(records: DataFrame, issues: DataFrame, events: DataFrame, detections: DataFrame, chains: DataFrame) -> DataFrame:
    """``name, n`` of a dataset run: rows read, issues, events stored and skipped, findings, chains and attack chains.

    ``rows_read`` are records and rows with an issue; ``events`` are the normalized records.  Each table is read once.
    """
    typed = F.col("event_type").isNotNull()
    own = tally(records.select(F.lit(False).alias("bad")).unionByName(issues.select(F.lit(True).alias("bad"))), rows_read=F.lit(True), issues=F.col("bad"))
    kept = tally(events, stored=typed, skipped=~typed)
    told = tally(detections, detections=F.lit(True))
    return own.unionByName(kept).unionByName(told).unionByName(tally(chains, chains=F.lit(True), attack_chains=F.col("is_attack")))


def by_scenario(events: DataFrame, detections: DataFrame, members: DataFrame, chains: DataFrame) -> DataFrame:
    """``scenario_id, events, detections, chains, attack_chains, chain_list``; a chain counts in each scenario of its events."""
    scenario = events.select("event_id", "scenario_id")
    own = scenario.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("events"))
    found = detections.join(scenario, "event_id").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("detections"))
    held = members.join(scenario, "event_id").select("scenario_id", "chain").distinct().join(chains.select("chain", "is_attack"), "chain")
    held = held.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("chains"), F.count_if("is_attack").alias("attack_chains"), F.array_join(F.sort_array(F.collect_list("chain")), ",").alias("chain_list"))
    out = own.join(found, "scenario_id", "left").join(held, "scenario_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("detections", "chains", "attack_chains")}
    return out.withColumns(zero).withColumn("chain_list", F.coalesce("chain_list", F.lit("")))


def facets(events: DataFrame) -> DataFrame:
    """``facet, value``: distinct hosts and users."""
    return by_value(events, "facet", host="host", user="user").where("name is not null").select("facet", F.col("name").alias("value"))


def chain_detail(chains: DataFrame, **lists: DataFrame) -> DataFrame:
    """Chains with a sorted array of structs of each given table, whose rows name their chain."""
    for name, rows in lists.items():
        grouped = rows.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "chain"]))).alias(name))
        chains = chains.join(grouped, "chain", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return chains
