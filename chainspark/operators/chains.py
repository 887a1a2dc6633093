"""Chains: seeded components of edges, their roll-ups, confidence, risk, gaps and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.config import DEFAULT, Settings
from chainspark.dims import SEVERITIES, severity_rank, suggestions, tactic_index, tactic_risk, tactic_stage, tactics
from chainspark.functions.substrings import contained
from chainspark.functions.scalars import basename, filled, text
from chainspark.operators import counted
from chainspark.operators.blocking import LINK_PAIRS
from chainspark.operators.components import components
from chainspark.operators.correlate import GROUPS, LABELS, SIGNALS, _keyed, as_pairs, correlate, edges_of, is_strong, links, meets, pair_details, score_pairs, time_alone
from chainspark.operators.entities import event_entities
from chainspark.sinks.store import kept

#: Stored rows that are made when they are needed.
Rows = Callable[[], DataFrame] | None


def chain_members(edges: DataFrame, events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``chain, event_id, sec, position``: a chain is named by its smallest event id.

    Edges join where both ends carry a technique, or one does and the score is high.
    """
    return _members(edges.where(is_strong(cfg)), events)


def linked_members(events: DataFrame, cfg: Settings = DEFAULT, isolate_by: tuple[str, ...] = (), rows: Rows = None) -> DataFrame:
    """``chain_members`` of all edges of the events, by as few edges as connect the same."""
    return _placed(clusters(events, cfg, isolate_by, strong=True, rows=rows), events)


def clusters(events: DataFrame, cfg: Settings = DEFAULT, isolate_by: tuple[str, ...] = (), strong: bool = False, most: int = LINK_PAIRS, rows: Rows = None) -> DataFrame:
    """``event_id, component`` over all edges of the events, or over all that join chains; ``rows()`` has the events ``prepared`` and stored, if they are needed."""
    keyed = _keyed(events, isolate_by)
    if time_alone(cfg) >= cfg.min_edge_score or not counted.is_busy(keyed, isolate_by, most, events):
        return components(links(events, cfg, isolate_by, strong))
    return counted.connected(rows() if rows else kept(prepared(events, cfg, isolate_by)), cfg, isolate_by, strong)


def prepared(events: DataFrame, cfg: Settings = DEFAULT, isolate_by: tuple[str, ...] = ()) -> DataFrame:
    """Events as ``clusters`` and ``tally`` read them where they are many; to be stored."""
    return counted.prepared(_keyed(events, isolate_by), cfg, isolate_by)


def _members(strong: DataFrame, events: DataFrame) -> DataFrame:
    return _placed(components(strong), events)


def _placed(parts: DataFrame, events: DataFrame) -> DataFrame:
    found = parts.withColumnRenamed("component", "chain")
    order = Window.partitionBy("chain").orderBy(F.asc_nulls_last("sec"), "event_id")
    return found.join(events.select("event_id", "sec"), "event_id").withColumn("position", F.row_number().over(order))


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """All accepted edges with both ends in one chain."""
    a, b = (members.select(F.col("event_id").alias(f"event_{s}"), F.col("chain").alias(f"chain_{s}")) for s in "ab")
    met = edges.join(a, "event_a").join(b, "event_b").where("chain_a = chain_b")
    return met.withColumnRenamed("chain_a", "chain").drop("chain_b")


def _points() -> dict[str, Column]:
    """Points of each signal group."""
    return {g: sum((F.col(s) for s in signals[1:]), F.col(signals[0])) for g, signals in GROUPS.items()}


def in_chains(events: DataFrame, members: DataFrame) -> DataFrame:
    return events.join(members.select("event_id", "chain"), "event_id")


def tally(events: DataFrame, members: DataFrame, cfg: Settings = DEFAULT, most: int = LINK_PAIRS, rows: Rows = None) -> DataFrame:
    """``chain, event_a, links, best``, each group's summed points and ``best_<group>``: what the internal edges of each earlier event come to.

    Edges are made chain by chain and counted as they are made; none is stored or moved.  ``best`` is the highest
    score, ``best_<group>`` that among edges with points in the group.  ``rows()`` has the events ``prepared`` and stored, if they are needed.
    """
    inside = in_chains(events, members)
    if time_alone(cfg) < cfg.min_edge_score and counted.countable(cfg):
        keyed = _keyed(inside, ("chain",))
        if counted.is_busy(keyed, ("chain",), most, members):
            if rows is None:
                return counted.tallied(kept(counted.prepared(keyed, cfg, ("chain",))), cfg, ("chain",))
            # What events hold and share is told of all of them, which is no less than of a chain's.
            of = members.select(F.col("event_id").alias("id"), "chain")
            return counted.tallied(kept(rows().drop("chain").join(of, F.col("e.event_id") == F.col("id")).drop("id")), cfg, ("chain",))
    made = correlate(inside, cfg, isolate_by=("chain",))
    sums = [F.sum(p).alias(g) for g, p in _points().items()]
    bests = [F.max(F.when(p > 0, F.col("total"))).alias(f"best_{g}") for g, p in _points().items()]
    return made.groupBy("chain", "event_a").agg(F.count(F.lit(1)).alias("links"), F.max("total").alias("best"), *sums, *bests)


def edge_kinds(events: DataFrame, cfg: Settings = DEFAULT, most: int = LINK_PAIRS, rows: Rows = None) -> DataFrame:
    """``window``, points of each signal, ``total`` and ``n``: how many of all edges of the events there are of each kind."""
    if time_alone(cfg) < cfg.min_edge_score and counted.countable(cfg) and counted.is_busy(_keyed(events, ()), (), most, events):
        return counted.kinds(rows() if rows else kept(prepared(events, cfg)), cfg)
    return correlate(events, cfg).groupBy("window", *SIGNALS, "total").agg(F.count(F.lit(1)).alias("n"))


def every_edge(events: DataFrame, cfg: Settings = DEFAULT, most: int = LINK_PAIRS, rows: Rows = None) -> DataFrame:
    """``event_a, event_b, window, total`` and points of each signal of all edges of the events."""
    if time_alone(cfg) < cfg.min_edge_score and counted.countable(cfg) and counted.is_busy(_keyed(events, ()), (), most, events):
        return counted.edges(rows() if rows else kept(prepared(events, cfg)), cfg)
    return correlate(events, cfg).select("event_a", "event_b", "window", "total", *SIGNALS)


def edges_from(starts: DataFrame, events: DataFrame, members: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Internal edges whose earlier event is one of ``starts`` (``chain, event_a`` and more, which stays): a few of a chain, so each meets the whole chain."""
    more = [c for c in starts.columns if c != "event_a"]
    return edges_of(score_pairs(meets(starts, in_chains(events, members), "chain", cfg), cfg, keep=tuple(more)), cfg)


def confidence(internal: DataFrame) -> DataFrame:
    """``chain, confidence, links`` and each group's mean points over all internal links."""
    means = [F.avg(p).alias(g) for g, p in _points().items()]
    return _confidence(internal.groupBy("chain").agg(F.count(F.lit(1)).alias("links"), *means))


def confidence_of(tallied: DataFrame) -> DataFrame:
    """``confidence`` from a ``tally``."""
    links = F.sum("links")
    return _confidence(tallied.groupBy("chain").agg(links.alias("links"), *[(F.sum(g) / links).alias(g) for g in GROUPS]))


def _confidence(grouped: DataFrame) -> DataFrame:
    kept = [F.when(F.col(g) >= 0.5, F.col(g)).otherwise(0.0) for g in GROUPS]
    total = sum(kept[1:], kept[0])
    shown = [F.when(F.col(g) >= 0.5, F.bround(F.col(g), 1)).alias(g) for g in GROUPS]
    return grouped.select("chain", "links", F.bround(F.least(F.lit(100.0), total), 1).alias("confidence"), *shown)


def _in_order(found: DataFrame, value: str, order: list, name: str) -> DataFrame:
    """Per chain the distinct values in order of their first place."""
    first = found.where(F.col(value).isNotNull()).groupBy("chain", value).agg(F.min(F.struct(*order)).alias("place"))
    listed = F.sort_array(F.collect_list(F.struct("place", value)))
    return first.groupBy("chain").agg(F.transform(listed, lambda x: x[value]).alias(name))


def confidence_reasons(tallied: DataFrame, events: DataFrame, members: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``chain, group, label, points, event_a, event_b, explanation``: the groups that make up a chain's confidence.

    Points are means over all internal links; the explanation is what the strongest link with
    points in the group says.
    """
    links = tallied.groupBy("chain").agg(F.sum("links").alias("links"))
    each = [F.struct(F.lit(g).alias("group"), F.col(g).alias("points"), F.col(f"best_{g}").alias("best")) for g in GROUPS]
    spread = tallied.select("chain", "event_a", F.inline(F.array(*each))).where("points > 0")
    first = F.min(F.struct((-F.col("best")).alias("down"), "event_a")).alias("first")
    grouped = spread.groupBy("chain", "group").agg(F.sum("points").alias("points"), first).join(links, "chain")
    mean = F.col("points") / F.col("links")
    named = grouped.where(mean >= 0.5).select("chain", "group", F.bround(mean, 1).alias("points"), (-F.col("first.down")).alias("best"), "first.event_a")
    starts = named.groupBy("chain", "event_a").agg(F.map_from_entries(F.collect_list(F.struct("group", "best"))).alias("wanted"))
    found = edges_from(starts, events, members, cfg)
    has = [F.when((p > 0) & (F.col("total") == F.element_at("wanted", F.lit(g))), F.lit(g)) for g, p in _points().items()]
    second = found.select("chain", "event_a", "event_b", F.explode(F.array_compact(F.array(*has))).alias("group")).groupBy("chain", "event_a", "group").agg(F.min("event_b").alias("event_b"))
    kept = named.drop("best").join(second, ["chain", "event_a", "group"])
    example = score_pairs(as_pairs(kept.select("event_a", "event_b").distinct(), events), cfg, keep=("a", "b"))
    signal_group = F.expr("map(" + ", ".join(f"'{s}', '{g}'" for g, signals in GROUPS.items() for s in signals) + ")")
    says = pair_details(example).withColumn("group", F.element_at(signal_group, F.col("signal")))
    order = F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("signal"))
    says = says.groupBy("event_a", "event_b", "group").agg(F.min_by("detail", order).alias("explanation"))
    label = F.element_at(F.expr("map(" + ", ".join(f"'{g}', '{w}'" for g, w in LABELS.items()) + ")"), F.col("group"))
    return kept.join(says, ["event_a", "event_b", "group"], "left").select("chain", "group", label.alias("label"), "points", "event_a", "event_b", "explanation")


def strongest_links(tallied: DataFrame, events: DataFrame, members: DataFrame, most: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Internal edges of each chain among which are its first ``most`` by score, then ids.

    They start at the first ``most`` events by their best score: an edge comes after the best one of every event before its own.
    """
    order = Window.partitionBy("chain").orderBy(F.desc("best"), "event_a")
    starts = tallied.select("chain", "event_a", F.row_number().over(order).alias("r"), "best").where(F.col("r") <= most)
    return edges_from(starts.select("chain", "event_a"), events, members, cfg)


def roll_up(members: DataFrame, events: DataFrame, detections: DataFrame) -> DataFrame:
    """Per chain: span, counts, hosts, users and processes, techniques and tactics, and risk.

    Techniques stand in order of events, those of detections alone after them; tactics in
    kill-chain order, unknown ones last.
    """
    rows = members.select("chain", "event_id", "position").join(events, "event_id")
    process = F.explode(F.array_distinct(F.array_compact(F.array(filled(F.col("process_name")), filled(F.col("parent_process"))))))
    processes = rows.select("chain", process.alias("p")).groupBy("chain").agg(F.sort_array(F.collect_set("p")).alias("processes"))
    own = rows.groupBy("chain").agg(
        F.min("sec").alias("start_sec"),
        F.max("sec").alias("end_sec"),
        F.count(F.lit(1)).alias("events"),
        F.sort_array(F.collect_set(filled(F.col("host")))).alias("hosts"),
        F.sort_array(F.collect_set(filled(F.col("user")))).alias("users"),
        F.max(severity_rank(F.col("severity"))).alias("own_peak"),
    )
    found = members.select("chain", "event_id", "position").join(detections.select("event_id", "rule_ord", "technique_id", "tactic", "severity"), "event_id")
    seen = found.groupBy("chain").agg(F.count(F.lit(1)).alias("detections"), F.max(severity_rank(F.col("severity"))).alias("det_peak"))
    both = rows.select("chain", "technique_id", "tactic", F.lit(0).alias("late"), "position", F.lit(0).alias("rule_ord"))
    both = both.unionByName(found.select("chain", "technique_id", "tactic", F.lit(1).alias("late"), "position", "rule_ord"))
    techniques = _in_order(both, "technique_id", ["late", "position", "rule_ord"], "techniques")
    by_stage = F.coalesce(tactic_index(F.col("tactic")), F.lit(99)).alias("idx")
    known = _in_order(both, "tactic", [by_stage, "tactic"], "tactics")
    out = own.join(seen, "chain", "left").join(processes, "chain", "left").join(techniques, "chain", "left").join(known, "chain", "left")
    none = F.array().cast("array<string>")
    out = out.select(
        "chain",
        "start_sec",
        "end_sec",
        (F.col("end_sec") - F.col("start_sec")).alias("duration"),
        "events",
        F.coalesce("detections", F.lit(0)).cast("long").alias("detections"),
        *[F.coalesce(c, none).alias(c) for c in ("hosts", "users", "processes", "techniques", "tactics")],
        F.greatest("own_peak", F.coalesce("det_peak", F.lit(0))).alias("peak"),
    )
    by_tactic = F.aggregate("tactics", F.lit(0), lambda acc, t: acc + tactic_risk(t))
    peak = F.element_at(F.array(*[F.lit(p) for _, _, p in SEVERITIES]), F.col("peak") + 1)
    breadth = lambda c, step, most: F.when(F.size(c) > 1, F.least(F.lit(most), step * (F.size(c) - 1))).otherwise(0)
    risk = F.least(F.lit(100), peak + by_tactic + breadth("hosts", 4, 10) + breadth("users", 3, 8) + F.least(F.lit(10), F.size("techniques")))
    level = F.when(F.col("risk") >= 90, "CRITICAL").when(F.col("risk") >= 56, "HIGH").when(F.col("risk") >= 30, "MEDIUM").otherwise("LOW")
    stages = F.sort_array(F.array_distinct(F.array_compact(F.transform("tactics", tactic_stage))))
    return out.withColumn("risk", risk).withColumn("risk_level", level).withColumn("stages", stages)


def verdicts(rolled: DataFrame, conf: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Chains with confidence, verdict and a number by first activity."""
    both = rolled.join(conf.select("chain", "confidence", "links"), "chain", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    attack = (F.col("confidence") >= cfg.attack_confidence) & (F.col("risk") >= cfg.attack_risk) & ((F.col("detections") > 0) | (F.size("techniques") > 0))
    return both.withColumn("is_attack", attack)


def numbered(chains: DataFrame) -> DataFrame:
    """``chain_no`` by first activity: ranks within time ranges, offset by the rows before each range.

    The chain table is ordered over all tasks; only one count a range passes through one place.
    """
    order = [F.asc_nulls_last("start_sec"), F.asc("chain")]
    ranged = chains.select("chain", "start_sec").withColumn("slot", F.coalesce(F.floor(F.col("start_sec") / 86_400), F.lit(1 << 40)))
    counts = ranged.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    return chains.join(inside.join(before, "slot").select("chain", F.format_string("CHN-%04d", (F.col("before") + F.col("r")).cast("long")).alias("chain_no")), "chain")


def missing_steps(chains: DataFrame, members: DataFrame, events: DataFrame, top: int = 4) -> DataFrame:
    """``chain, kind, tactic, technique_id, confidence``: at most four inferred steps a chain."""
    spark = chains.sparkSession
    order = tactics(spark).select(F.col("tactic").alias("gap"), F.col("idx").alias("gap_idx"))
    known = F.filter(F.transform("tactics", tactic_index), lambda i: i.isNotNull())
    seen = chains.select("chain", "confidence", "techniques", known.alias("idx")).where(F.size("idx") > 0)
    seen = seen.withColumn("first", F.array_min("idx")).withColumn("last", F.array_max("idx"))
    inner = seen.withColumn("gap_idx", F.explode(F.sequence("first", "last"))).where(~F.array_contains("idx", F.col("gap_idx")))
    distance = F.array_min(F.transform(F.filter("idx", lambda i: i > F.col("gap_idx")), lambda i: i - F.col("gap_idx")))
    base = F.when(distance == 1, 66.0).when(distance == 2, 56.0).when(distance == 3, 47.0).otherwise(40.0)
    low = F.when(F.col("confidence") < 50, 8.0).otherwise(0.0)
    gaps = inner.join(F.broadcast(order), "gap_idx").join(F.broadcast(suggestions(spark)).withColumnRenamed("tactic", "gap"), "gap")
    step = lambda kind, tactic, technique, sure: ("chain", F.lit(kind).alias("kind"), tactic.alias("tactic"), technique.alias("technique_id"), sure.alias("confidence"))
    gaps = gaps.select(*step("MISSING_TACTIC_GAP", F.col("gap"), F.col("technique_id"), F.greatest(F.lit(25.0), base - low)))
    rows = members.join(events.select("event_id", "event_type", "host", "file_path", "command_line", "process_name"), "event_id")
    made = rows.where((F.col("event_type") == "FILE_CREATED") & filled(F.col("file_path")).isNotNull())
    made = made.select("chain", F.col("position").alias("made_at"), basename(text(F.col("file_path"))).alias("base"), F.col("host").alias("made_host"))
    ran = rows.where(F.col("event_type") == "PROCESS_CREATED")
    ran = ran.select("chain", "position", "host", text(F.col("command_line")).alias("command"), text(F.col("process_name")).alias("process"))
    # One row a written name: a later run on its host, or anywhere if it was written without a host.
    made = made.where("base <> ''").groupBy("chain", "base", "made_host").agg(F.min("made_at").alias("made_at"))
    runs = ran.where("command <> '' or process <> ''").groupBy("chain", "host", "command", "process").agg(F.max("position").alias("position"))
    there = F.col("made_host").isNull() | F.col("made_host").eqNullSafe(F.col("host"))
    held = contained(made.select("chain", F.col("base").alias("needle")), runs.select("chain", F.col("command").alias("text")), "chain")
    in_command = made.join(held.withColumnRenamed("needle", "base"), ["chain", "base"]).join(runs.withColumnRenamed("command", "text"), ["chain", "text"])
    by_name = made.join(runs.withColumn("base", F.col("process")), ["chain", "base"])
    seen_run = ["chain", "made_host", "host", "made_at", "position"]
    used = in_command.select(*seen_run).unionByName(by_name.select(*seen_run)).where(there & (F.col("position") > F.col("made_at")))
    executed = used.select("chain").distinct().join(seen.select("chain", "confidence", "techniques"), "chain")
    executed = executed.where(~F.exists("techniques", lambda t: t.startswith("T1204")))
    sure = F.when(F.col("confidence") >= 50, 61.0).otherwise(50.0)
    executed = executed.select(*step("MISSING_EXECUTION_STEP", F.lit("EXECUTION"), F.lit("T1204.002"), sure))
    ranked = Window.partitionBy("chain").orderBy(F.desc("confidence"), F.coalesce(tactic_index(F.col("tactic")), F.lit(99)), "kind")
    strongest = gaps.unionByName(executed).where("confidence >= 45").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= top).drop("r")
    late = seen.where((F.col("first") > 2) & ~F.arrays_overlap("idx", F.array(F.lit(2), F.lit(4), F.lit(7))))
    late = late.select(*step("MISSING_PRE_CHAIN", F.lit("INITIAL ACCESS"), F.lit("T1566"), F.lit(46.0)))
    # The pre-chain step joins after the first cut and gives way to four stronger ones.
    again = Window.partitionBy("chain").orderBy((F.col("kind") == "MISSING_PRE_CHAIN").cast("int"), F.desc("confidence"))
    return strongest.unionByName(late).withColumn("r", F.row_number().over(again)).where(F.col("r") <= top).drop("r")


def attack_path(members: DataFrame, events: DataFrame, steps: DataFrame) -> DataFrame:
    """``chain, stage, kind, tactic, technique_id, first_sec``: observed tactics by time, gaps filled with inferred steps."""
    rows = members.select("chain", "event_id").join(events.select("event_id", "sec", "tactic", "technique_id"), "event_id")
    rows = rows.withColumn("idx", tactic_index(F.col("tactic"))).where("idx is not null")
    when = F.struct(F.coalesce("sec", F.lit(1 << 62)), F.col("event_id"))
    seen = rows.groupBy("chain", "tactic", "idx").agg(F.min("sec").alias("first_sec"), F.min_by("technique_id", when).alias("technique_id"))
    order = Window.partitionBy("chain").orderBy(F.asc_nulls_last("first_sec"), "idx")
    seen = seen.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("idx").over(order))
    filled_in = seen.select("chain", "place", F.col("idx").alias("from"), "next").join(
        steps.groupBy("chain", F.col("tactic")).agg(F.max_by("technique_id", "confidence").alias("technique_id")).withColumn("idx", tactic_index(F.col("tactic"))), "chain"
    ).where((F.col("idx") > F.col("from")) & (F.col("idx") < F.col("next")))
    observed = seen.select("chain", "place", F.lit(-1).alias("sub"), F.lit("OBSERVED").alias("kind"), "tactic", "technique_id", "first_sec")
    inferred = filled_in.select("chain", "place", F.col("idx").alias("sub"), F.lit("INFERRED").alias("kind"), "tactic", "technique_id", F.lit(None).cast("long").alias("first_sec"))
    stage = F.row_number().over(Window.partitionBy("chain").orderBy("place", "sub"))
    return observed.unionByName(inferred).select("chain", stage.alias("stage"), "kind", "tactic", "technique_id", "first_sec")


def chain_entities(members: DataFrame, events: DataFrame) -> DataFrame:
    """``chain, entity_type, value, label, role, events``: distinct entities of a chain with their first role."""
    rows = event_entities(events).join(members.select("chain", "event_id", "position"), "event_id")
    label = F.when(F.col("entity_type") == "PROCESS", F.regexp_replace("value", "^[^:]*:", "")).otherwise(F.col("value"))
    grouped = rows.groupBy("chain", "entity_type", "value").agg(F.min_by("role", "position").alias("role"), F.count(F.lit(1)).alias("events"))
    return grouped.withColumn("label", label)


def chain_detections(members: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of each chain's events, with the event's position."""
    return members.select("chain", "event_id", "position").join(detections, "event_id")


EVIDENCE = ("chain", "kind", "type", "place", "event_id", "severity", "points", "summary")


def evidence(members: DataFrame, events: DataFrame, detections: DataFrame, internal: DataFrame, steps: DataFrame, links: int = 6) -> DataFrame:
    """``EVIDENCE``: detections (highest severity name first), the strongest links, the span, and inferred steps."""
    null = lambda kind: F.lit(None).cast(kind)
    by_severity = Window.partitionBy("chain").orderBy(F.desc("severity"), "position", "rule_ord")
    found = chain_detections(members, detections).select(
        "chain", F.lit("OBSERVED").alias("kind"), F.lit("DETECTION").alias("type"), F.row_number().over(by_severity).alias("place"),
        "event_id", "severity", null("double").alias("points"), F.col("title").alias("summary"),
    )
    by_total = Window.partitionBy("chain").orderBy(F.desc("total"), "event_a", "event_b")
    groups = [F.when(sum((F.col(s) for s in signals[1:]), F.col(signals[0])) > 0, F.lit(g)) for g, signals in sorted(GROUPS.items())]
    words = F.concat(F.lit("linked by "), F.concat_ws(", ", *groups), F.lit(" with "), F.col("total").cast("string"), F.lit(" points"))
    strongest = internal.withColumn("place", F.row_number().over(by_total)).where(F.col("place") <= links)
    strongest = strongest.select(
        "chain", F.lit("OBSERVED").alias("kind"), F.lit("CORRELATION_LINK").alias("type"), "place",
        F.concat_ws(",", "event_a", "event_b").alias("event_id"), null("string").alias("severity"), F.col("total").cast("double").alias("points"), words.alias("summary"),
    )
    rows = members.select("chain", "event_id", "position").join(events.select("event_id", "event_type"), "event_id")
    ends = rows.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("event_id", "event_type"), "position").alias("first"), F.max_by(F.struct("event_id", "event_type"), "position").alias("last")
    )
    span = F.concat(F.col("n").cast("string"), F.lit(" events, "), F.col("first.event_type"), F.lit(" to "), F.col("last.event_type"))
    bounds = ends.select(
        "chain", F.lit("OBSERVED").alias("kind"), F.lit("TIMELINE_BOUNDS").alias("type"), F.lit(1).alias("place"),
        F.concat_ws(",", "first.event_id", "last.event_id").alias("event_id"), null("string").alias("severity"), null("double").alias("points"), span.alias("summary"),
    )
    by_confidence = Window.partitionBy("chain").orderBy(F.desc("confidence"), "technique_id", "kind")
    guessed = steps.select(
        "chain", F.lit("INFERRED").alias("kind"), F.lit("MISSING_STEP").alias("type"), F.row_number().over(by_confidence).alias("place"),
        null("string").alias("event_id"), null("string").alias("severity"), F.col("confidence").alias("points"),
        F.concat_ws(" ", "technique_id", F.lit("may be missing in"), "tactic").alias("summary"),
    )
    return found.unionByName(strongest).unionByName(bounds).unionByName(guessed)


def evidence_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain", "kind", "type").agg(F.count(F.lit(1)).alias("n"))


def _some(words: str, c: str) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(words), F.array_join(c, ", ")))


def one_line(chains: DataFrame) -> DataFrame:
    """``chain, summary``: a chain in a sentence."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = F.concat_ws("; ", F.concat(F.col("events").cast("string"), F.lit(" events")), _some("hosts ", "hosts"), _some("accounts ", "users"), _some("tactics ", "tactics"))
    window = F.when(F.col("start_sec").isNotNull(), F.concat(F.lit(" from "), stamp("start_sec"), F.lit(" to "), stamp("end_sec"))).otherwise("")
    scores = F.format_string(". Confidence %d%%, risk %s (%d of 100).", F.bround("confidence", 0).cast("int"), "risk_level", F.col("risk").cast("int"))
    return chains.select("chain", F.concat(parts, window, scores).alias("summary"))
