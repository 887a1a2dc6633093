"""Attack graph of chains, process trees and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.scalars import filled, process_value, text
from chainspark.sinks.store import cut


def graph_edges(members: DataFrame, events: DataFrame, detections: DataFrame) -> DataFrame:
    """``chain, source, target, relation``: one edge a pair of nodes, the last written wins.

    Nodes are ``KIND:value``.  Write order is by event, then host, user, actor, parent, parent to
    child, file, destination, source, domain, technique; then findings by rule; then succession.
    """
    rows = members.select("chain", "event_id", "position").join(events, "event_id")
    host = F.col("host")
    actor, parent = (process_value(host, F.col(c)) for c in ("process_name", "parent_process"))
    node = lambda kind, v: F.concat(F.lit(kind + ":"), v)
    me = node("EVENT", F.col("event_id"))
    links = [
        (0, me, node("HOST", host), "OBSERVED_ON"), (1, node("USER", F.col("user")), me, "PERFORMED"), (2, node("PROCESS", actor), me, "EXECUTED"),
        (3, me, node("PROCESS", parent), "PARENT"), (4, node("PROCESS", parent), node("PROCESS", actor), "SPAWNED"), (5, me, node("FILE", F.col("file_path")), "TOUCHED"),
        (6, me, node("IP", F.col("destination_ip")), "CONNECTED"), (7, node("IP", F.col("source_ip")), me, "ORIGIN"), (8, me, node("DOMAIN", F.col("domain")), "QUERIED"),
        (9, me, node("TECHNIQUE", F.col("technique_id")), "MAPPED"),
    ]
    edge = lambda o, s, t, r: F.struct(F.lit(o).alias("slot"), s.alias("source"), t.alias("target"), F.lit(r).alias("relation"))
    made = F.array_compact(F.array(*[F.when(s.isNotNull() & t.isNotNull() & (s != t), edge(o, s, t, r)) for o, s, t, r in links]))
    own = rows.select("chain", F.col("position").cast("long").alias("place"), F.explode(made).alias("x")).select("chain", "place", "x.*")
    found = members.select("chain", "event_id").join(detections.select("event_id", "rule_ord", "technique_id"), "event_id")
    ends = (node("EVENT", F.col("event_id")).alias("source"), node("TECHNIQUE", F.col("technique_id")).alias("target"))
    found = found.select("chain", F.lit(1 << 40).alias("place"), F.col("rule_ord").alias("slot"), *ends, F.lit("DETECTED").alias("relation"))
    order = Window.partitionBy("chain").orderBy("position")
    after = members.select("chain", "position", me.alias("source"), node("EVENT", F.lead("event_id").over(order)).alias("target")).where("target is not null")
    after = after.select("chain", F.lit(1 << 41).alias("place"), F.col("position").cast("int").alias("slot"), "source", "target", F.lit("PRECEDES").alias("relation"))
    last = F.max_by("relation", F.struct("place", "slot")).alias("relation")
    return own.unionByName(found).unionByName(after).groupBy("chain", "source", "target").agg(last)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """``chain, node, type, label``: the ends of all edges; a process is labelled without its host."""
    node = F.explode(F.array("source", "target")).alias("node")
    kind, value = F.substring_index("node", ":", 1), F.regexp_replace("node", "^[^:]*:", "")
    label = F.when(kind == "PROCESS", F.regexp_replace(value, "^[^:]*:", "")).otherwise(value)
    return edges.select("chain", node).distinct().select("chain", "node", kind.alias("type"), label.alias("label"))


def graph_meta(edges: DataFrame) -> DataFrame:
    """``chain, what, name, n``: nodes of each type and edges of each relation."""
    nodes = graph_nodes(edges).groupBy("chain", F.lit("node").alias("what"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(edges.groupBy("chain", F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def acyclic(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``chain, is_dag``.

    Events follow each other in one line, so a cycle either runs among processes alone, or leaves
    the line at an event, passes through processes or an address, and returns no later.  Each
    process hears the latest event before it, along parents to children, until nothing changes;
    processes whose parents are all settled are peeled off to find cycles among them.
    """
    place = members.select("chain", F.concat(F.lit("EVENT:"), F.col("event_id")).alias("event"), "position")
    through = lambda c: F.col(c).startswith("PROCESS:") | F.col(c).startswith("IP:")
    left = edges.where(F.col("source").startswith("EVENT:") & through("target")).withColumnRenamed("source", "event").join(place, ["chain", "event"])
    latest = cut(left.groupBy("chain", F.col("target").alias("node")).agg(F.max("position").alias("at")))
    back = edges.where(through("source") & F.col("target").startswith("EVENT:")).withColumnRenamed("target", "event").join(place, ["chain", "event"])
    earliest = cut(back.groupBy("chain", F.col("source").alias("node")).agg(F.min("position").alias("from")))
    spawned = cut(edges.where(F.col("source").startswith("PROCESS:") & F.col("target").startswith("PROCESS:")).select("chain", "source", "target"))
    while True:
        heard = spawned.join(latest.withColumnRenamed("node", "source"), ["chain", "source"]).select("chain", F.col("target").alias("node"), "at")
        grown = cut(latest.unionByName(heard).groupBy("chain", "node").agg(F.max("at").alias("at")))
        if grown.exceptAll(latest).isEmpty():
            break
        latest = grown
    loops = latest.join(earliest, ["chain", "node"]).where(F.col("at") >= F.col("from")).select("chain")
    rest = spawned
    while True:
        held = rest.select("chain", F.col("target").alias("source")).distinct()
        fewer = cut(rest.join(held, ["chain", "source"], "left_semi"))
        if fewer.isEmpty() or fewer.count() == rest.count():
            break
        rest = fewer
    loops = loops.unionByName(fewer.select("chain")).distinct().withColumn("loop", F.lit(True))
    return members.select("chain").distinct().join(loops, "chain", "left").select("chain", F.col("loop").isNull().alias("is_dag"))


def first_events_graph(events: DataFrame, detections: DataFrame, most: int = 2000) -> DataFrame:
    """Graph of the first ``most`` events by time (a feature: an overview), as one chain ``all``."""
    first = events.select("event_id", "sec").orderBy(F.asc_nulls_last("sec"), "event_id").limit(most)
    position = F.row_number().over(Window.orderBy(F.asc_nulls_last("sec"), "event_id"))  # of the limited rows
    members = first.select(F.lit("all").alias("chain"), "event_id", position.alias("position"))
    return graph_edges(members, events, detections)


def process_nodes(members: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes of process trees: one a chain, host, pid and name, with its first event's values and first command line."""
    rows = members.select("chain", "event_id", "position").join(events, "event_id").where(filled(F.col("process_name")).isNotNull())
    on_host = text(F.col("host")).alias("on_host")
    first = lambda c: F.min_by(c, "position").alias(c)
    at = F.when(filled(F.col("command_line")).isNotNull(), F.col("position"))
    return rows.groupBy("chain", on_host, F.coalesce("process_id", F.lit(0)).alias("pid"), F.lower("process_name").alias("process")).agg(
        F.min("position").alias("position"),
        first("process_id"),
        F.min_by("parent_process_id", "position").alias("ppid"),
        F.lower(F.min_by("parent_process", "position")).alias("parent_name"),
        F.min_by("command_line", at).alias("command_line"),
        F.min_by("event_id", "position").alias("first_event"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"]).alias("event_ids"),
    )


def process_tree(members: DataFrame, events: DataFrame) -> DataFrame:
    """``chain, host, pid, process, parent_pid, parent, command_line, first_event, events``.

    The parent is the last node of the host with the parent's pid, else the first with its name;
    none for a root.  A node is not its own parent.
    """
    nodes = cut(process_nodes(members, events))
    key = ["chain", "on_host"]
    named = F.struct("pid", "process").alias("node")
    by_pid = nodes.where("process_id is not null").groupBy(*key, F.col("process_id").alias("ppid")).agg(F.max_by(F.struct("pid", "process"), "position").alias("by_pid"))
    by_name = nodes.groupBy(*key, F.col("process").alias("parent_name")).agg(F.min_by(F.struct("pid", "process"), "position").alias("by_name"))
    met = nodes.withColumn("node", named).join(by_pid, [*key, "ppid"], "left").join(by_name, [*key, "parent_name"], "left")
    parent = F.coalesce("by_pid", "by_name")
    parent = F.when(parent != F.col("node"), parent)
    return met.select(
        "chain", "on_host", "pid", "process", parent["pid"].alias("parent_pid"), parent["process"].alias("parent"), "command_line", "first_event", F.size("event_ids").cast("long").alias("events"), "event_ids"
    )


def _or(c: str, words: str) -> Column:
    return F.coalesce(filled(F.col(c)), F.lit(words))


def event_summary() -> Column:
    """A sentence for an event, by its type."""
    kind, cell = F.col("event_type"), lambda c: _or(c, "None")
    port = F.coalesce(F.col("destination_port").cast("string"), F.lit("?"))
    says = {
        "PROCESS_CREATED": F.concat_ws(" ", cell("process_name"), F.lit("started by"), _or("parent_process", "unknown parent")),
        "LOGIN_SUCCESS": F.concat_ws(" ", cell("user"), F.lit("logged on")),
        "LOGIN_ATTEMPT": F.concat_ws(" ", F.lit("failed logon of"), cell("user")),
        "FILE_CREATED": F.concat_ws(" ", F.lit("file"), cell("file_path"), F.lit("created")),
        "FILE_MODIFIED": F.concat_ws(" ", F.lit("file"), cell("file_path"), F.lit("modified")),
        "REGISTRY_MODIFIED": F.concat_ws(" ", F.lit("registry key"), cell("file_path"), F.lit("modified")),
        "NETWORK_CONNECTION": F.concat(_or("process_name", "process"), F.lit(" connected to "), cell("destination_ip"), F.lit(":"), port),
        "DNS_QUERY": F.concat_ws(" ", F.lit("name"), cell("domain"), F.lit("looked up")),
        "PRIVILEGE_CHANGE": F.concat_ws(" ", F.lit("privileges given to"), cell("user")),
        "SERVICE_CREATED": F.concat_ws(" ", F.lit("service installed:"), F.coalesce(filled(F.col("file_path")), F.col("command_line"), F.lit("None"))),
        "REMOTE_EXECUTION": F.concat_ws(" ", F.lit("remote command from"), _or("source_ip", "elsewhere")),
    }
    out = kind
    for k, v in says.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.concat_ws(" ", out, F.when(filled(F.col("host")).isNotNull(), F.concat(F.lit("on "), F.col("host"))))


def primary_entity() -> Column:
    return F.coalesce(*[filled(F.col(c)) for c in ("process_name", "file_path", "destination_ip", "domain", "user", "host")])


def timeline(members: DataFrame, events: DataFrame, detections: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``chain, seq, kind, event_id, sec, event_type, primary_entity, summary, technique_id, relations, findings``.

    Events stand in order of time; relations are the event's own edges other than succession.
    Inferred ``steps`` follow at the end, strongest first.
    """
    found = detections.groupBy("event_id").agg(
        F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("findings"), F.min_by("technique_id", "rule_ord").alias("found_technique")
    )
    edges = graph_edges(members, events, detections).where(F.col("source").startswith("EVENT:") & (F.col("relation") != "PRECEDES"))
    own = edges.groupBy("chain", F.substring("source", 7, 1 << 20).alias("event_id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "relation", "target"))), "; ").alias("relations")
    )
    said = events.select("event_id", "sec", "event_type", primary_entity().alias("primary_entity"), event_summary().alias("summary"), "technique_id")
    rows = members.select("chain", "event_id", F.col("position").alias("seq")).join(said, "event_id").join(found, "event_id", "left").join(own, ["chain", "event_id"], "left")
    rows = rows.select(
        "chain", "seq", F.lit("OBSERVED").alias("kind"), "event_id", "sec", "event_type", "primary_entity", "summary",
        F.coalesce("technique_id", "found_technique").alias("technique_id"), "relations", "findings",
    )
    if steps is None:
        return rows
    after = members.groupBy("chain").agg(F.max("position").alias("n"))
    place = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("confidence"), "technique_id", "kind"))
    guessed = steps.withColumn("r", place).join(after, "chain").select(
        "chain", (F.col("n") + F.col("r")).alias("seq"), F.lit("INFERRED").alias("kind"), F.lit("POSSIBLE_MISSING_STEP").alias("event_type"),
        F.col("technique_id").alias("primary_entity"), F.concat_ws(" ", F.lit("possible step in"), "tactic").alias("summary"), "technique_id",
    )
    return rows.unionByName(guessed, allowMissingColumns=True)


def network_rows(members: DataFrame, events: DataFrame) -> DataFrame:
    """Connections and name queries of chains in order of time: ``chain, position, kind, event_id, target, port, process, host``."""
    rows = members.select("chain", "event_id", "position").join(events, "event_id")
    kind = F.when(F.col("event_type") == "NETWORK_CONNECTION", "CONNECTION").when(F.col("event_type") == "DNS_QUERY", "QUERY")
    target = F.when(kind == "CONNECTION", F.col("destination_ip")).otherwise(F.col("domain"))
    port = F.when(kind == "CONNECTION", F.col("destination_port"))
    return rows.where(kind.isNotNull()).select("chain", "position", kind.alias("kind"), "event_id", target.alias("target"), port.alias("port"), F.col("process_name").alias("process"), "host")


def network_view(members: DataFrame, events: DataFrame) -> DataFrame:
    """Per chain: connections, queries, and the distinct destinations in order."""
    rows = members.select("chain", "event_id").join(events.select("event_id", "event_type", "destination_ip", "domain"), "event_id")
    connected = F.when(F.col("event_type") == "NETWORK_CONNECTION", filled(F.col("destination_ip")))
    return rows.groupBy("chain").agg(
        F.count_if(F.col("event_type") == "NETWORK_CONNECTION").alias("connections"),
        F.count_if(F.col("event_type") == "DNS_QUERY").alias("queries"),
        F.array_join(F.sort_array(F.collect_set(connected)), ",").alias("destinations"),
        F.countDistinct("domain").alias("domains"),
    )


def network_graph(edges: DataFrame) -> DataFrame:
    """Edges of connections and succession, and all that lead to an address or a name."""
    return edges.where(F.col("relation").isin("CONNECTED", "PRECEDES") | F.col("target").startswith("IP:") | F.col("target").startswith("DOMAIN:"))
