"""Queries of graphs, trees, timelines, reports and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.operators import filters, graph, views
from chainspark.operators import chains as C
from chainspark.plans.oracle_parts import CHAINS, CORRELATE, DETECT, EVIDENCE, with_
from chainspark.plans.queries import query
from chainspark.plans.stored import derived

_GRAPH = r"""links AS (SELECT chain, position::BIGINT AS place, slot, source, target, relation FROM (
  SELECT chain, position, 0 AS slot, 'EVENT:' || event_id AS source, 'HOST:' || host AS target, 'OBSERVED_ON' AS relation FROM me
  UNION ALL SELECT chain, position, 1, 'USER:' || "user", 'EVENT:' || event_id, 'PERFORMED' FROM me
  UNION ALL SELECT chain, position, 2, 'PROCESS:' || host || ':' || process_name, 'EVENT:' || event_id, 'EXECUTED' FROM me
  UNION ALL SELECT chain, position, 3, 'EVENT:' || event_id, 'PROCESS:' || host || ':' || parent_process, 'PARENT' FROM me
  UNION ALL SELECT chain, position, 4, 'PROCESS:' || host || ':' || parent_process, 'PROCESS:' || host || ':' || process_name, 'SPAWNED' FROM me
  UNION ALL SELECT chain, position, 5, 'EVENT:' || event_id, 'FILE:' || file_path, 'TOUCHED' FROM me
  UNION ALL SELECT chain, position, 6, 'EVENT:' || event_id, 'IP:' || destination_ip, 'CONNECTED' FROM me
  UNION ALL SELECT chain, position, 7, 'IP:' || source_ip, 'EVENT:' || event_id, 'ORIGIN' FROM me
  UNION ALL SELECT chain, position, 8, 'EVENT:' || event_id, 'DOMAIN:' || domain, 'QUERIED' FROM me
  UNION ALL SELECT chain, position, 9, 'EVENT:' || event_id, 'TECHNIQUE:' || technique_id, 'MAPPED' FROM me) WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target
  UNION ALL SELECT chain, 1099511627776, rule_ord, 'EVENT:' || event_id, 'TECHNIQUE:' || technique_id, 'DETECTED' FROM md
  UNION ALL SELECT chain, 2199023255552, position, 'EVENT:' || event_id, 'EVENT:' || nxt, 'PRECEDES' FROM (SELECT chain, position, event_id, lead(event_id) OVER (PARTITION BY chain ORDER BY position) AS nxt FROM members) WHERE nxt IS NOT NULL),
ge AS (SELECT chain, source, target, arg_max(relation, place * 1000000 + slot) AS relation FROM (SELECT chain, source, target, relation, place::HUGEINT AS place, slot FROM links) GROUP BY ALL)"""


def _chains(select: str, *more: str) -> str:
    return with_(select, DETECT, CORRELATE, CHAINS, *more, recursive=True)


def _joined(c: str, separator: str = ","):
    return F.array_join(c, separator).alias(c)


@query("graph_edges", _chains("SELECT * FROM ge", _GRAPH))
def graph_edges(spark, sf_dir):
    return derived(spark, sf_dir).graph


_NODES = """gn AS (SELECT DISTINCT chain, node FROM (SELECT chain, source AS node FROM ge UNION ALL SELECT chain, target FROM ge)),
gt AS (SELECT chain, node, split_part(node, ':', 1) AS type, CASE WHEN node LIKE 'PROCESS:%' THEN regexp_replace(substr(node, 9), '^[^:]*:', '') ELSE substr(node, strpos(node, ':') + 1) END AS label FROM gn)"""


@query("graph_nodes", _chains("SELECT * FROM gt", _GRAPH, _NODES))
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(derived(spark, sf_dir).graph)


@query("graph_meta", _chains("""SELECT chain, 'node' AS what, type AS name, count(*) AS n FROM gt GROUP BY ALL
  UNION ALL SELECT chain, 'edge', relation, count(*) FROM ge GROUP BY ALL""", _GRAPH, _NODES))  # fmt: skip
def graph_meta(spark, sf_dir):
    return graph.graph_meta(derived(spark, sf_dir).graph)


# Along spawned processes: what reaches what; an event that reaches a process which leads to it or an earlier one closes a cycle.
_LOOPS = """sp AS (SELECT DISTINCT chain, source AS a, target AS b FROM ge WHERE source LIKE 'PROCESS:%' AND target LIKE 'PROCESS:%'),
via AS (SELECT chain, a, b FROM sp UNION SELECT v.chain, v.a, s.b FROM via v JOIN sp s ON s.chain = v.chain AND s.a = v.b),
ends AS (SELECT chain, 'EVENT:' || event_id AS ev, position FROM members),
late AS (SELECT g.chain, target AS n, max(position) AS p FROM ge g JOIN ends x ON x.chain = g.chain AND x.ev = source WHERE target LIKE 'PROCESS:%' OR target LIKE 'IP:%' GROUP BY ALL),
soon AS (SELECT g.chain, source AS n, min(position) AS p FROM ge g JOIN ends x ON x.chain = g.chain AND x.ev = target WHERE source LIKE 'PROCESS:%' OR source LIKE 'IP:%' GROUP BY ALL),
loops AS (SELECT chain FROM via WHERE a = b UNION SELECT l.chain FROM late l JOIN soon s ON s.chain = l.chain AND s.n = l.n WHERE l.p >= s.p
  UNION SELECT l.chain FROM late l JOIN via v ON v.chain = l.chain AND v.a = l.n JOIN soon s ON s.chain = v.chain AND s.n = v.b WHERE l.p >= s.p)"""


@query("graph_is_dag", _chains("SELECT DISTINCT chain, chain NOT IN (SELECT chain FROM loops) AS is_dag FROM members", _GRAPH, _LOOPS))
def graph_is_dag(spark, sf_dir):
    d = derived(spark, sf_dir)
    return graph.acyclic(d.graph, d.members)


@query("graph_overview", with_("""SELECT relation, count(*) AS edges, count(DISTINCT source) AS sources FROM (SELECT DISTINCT source, target, arg_max(relation, place) OVER (PARTITION BY source, target) AS relation FROM (
  SELECT position * 100 + slot AS place, source, target, relation FROM (
  SELECT position, 0 AS slot, 'EVENT:' || event_id AS source, 'HOST:' || host AS target, 'OBSERVED_ON' AS relation FROM me UNION ALL SELECT position, 1, 'USER:' || "user", 'EVENT:' || event_id, 'PERFORMED' FROM me
  UNION ALL SELECT position, 2, 'PROCESS:' || coalesce(host || ':', '') || process_name, 'EVENT:' || event_id, 'EXECUTED' FROM me UNION ALL SELECT position, 3, 'EVENT:' || event_id, 'PROCESS:' || coalesce(host || ':', '') || parent_process, 'PARENT' FROM me
  UNION ALL SELECT position, 4, 'PROCESS:' || coalesce(host || ':', '') || parent_process, 'PROCESS:' || coalesce(host || ':', '') || process_name, 'SPAWNED' FROM me UNION ALL SELECT position, 5, 'EVENT:' || event_id, 'FILE:' || file_path, 'TOUCHED' FROM me
  UNION ALL SELECT position, 6, 'EVENT:' || event_id, 'IP:' || destination_ip, 'CONNECTED' FROM me UNION ALL SELECT position, 7, 'IP:' || source_ip, 'EVENT:' || event_id, 'ORIGIN' FROM me
  UNION ALL SELECT position, 8, 'EVENT:' || event_id, 'DOMAIN:' || domain, 'QUERIED' FROM me UNION ALL SELECT position, 9, 'EVENT:' || event_id, 'TECHNIQUE:' || technique_id, 'MAPPED' FROM me) WHERE source <> target
  UNION ALL SELECT 1000000000 + rule_ord, 'EVENT:' || event_id, 'TECHNIQUE:' || d.technique_id, 'DETECTED' FROM det d JOIN (SELECT event_id FROM me) USING (event_id)
  UNION ALL SELECT 2000000000, 'EVENT:' || event_id, 'EVENT:' || lead(event_id) OVER (ORDER BY position), 'PRECEDES' FROM me) WHERE source IS NOT NULL AND target IS NOT NULL) GROUP BY relation""",
  DETECT, "me AS (SELECT *, row_number() OVER (ORDER BY sec, event_id) AS position FROM e ORDER BY sec, event_id LIMIT 2000)"))
def graph_overview(spark, sf_dir):
    d = derived(spark, sf_dir)
    edges = graph.first_events_graph(d.events, d.detections)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"))


_TREE = """nodes AS (SELECT chain, lower(coalesce(host, '')) AS on_host, coalesce(process_id, 0) AS pid, lower(process_name) AS process, min(position) AS position, arg_min_null(process_id, position) AS own_pid,
  arg_min_null(parent_process_id, position) AS ppid, lower(arg_min_null(parent_process, position)) AS pname, arg_min(command_line, position) FILTER (WHERE command_line <> '') AS command_line, arg_min(event_id, position) AS first_event,
  count(*) AS events, string_agg(event_id, ',' ORDER BY position) AS event_list FROM me WHERE process_name IS NOT NULL GROUP BY ALL),
bp AS (SELECT chain, on_host, own_pid AS k, arg_max(pid, position) AS pid, arg_max(process, position) AS process FROM nodes WHERE own_pid IS NOT NULL GROUP BY ALL),
bn AS (SELECT chain, on_host, process AS k, arg_min(pid, position) AS pid FROM nodes GROUP BY ALL)"""


@query("process_tree", _chains("""SELECT n.chain, n.on_host, n.pid, n.process, CASE WHEN NOT me_ THEN par_pid END AS parent_pid, CASE WHEN NOT me_ THEN par END AS parent, command_line, first_event, events, event_list
  FROM (SELECT n.*, coalesce(bp.pid, bn.pid) AS par_pid, CASE WHEN bp.pid IS NOT NULL THEN bp.process ELSE bn.k END AS par, par_pid = n.pid AND par = n.process AS me_ FROM nodes n LEFT JOIN bp ON bp.chain = n.chain AND bp.on_host = n.on_host AND bp.k = n.ppid
  LEFT JOIN bn ON bn.chain = n.chain AND bn.on_host = n.on_host AND bn.k = n.pname) n""", _TREE))  # fmt: skip
def process_tree(spark, sf_dir):
    d = derived(spark, sf_dir)
    out = graph.process_tree(d.members, d.events)
    return out.withColumn("event_list", F.array_join("event_ids", ",")).drop("event_ids")


_SAYS = """CASE event_type WHEN 'PROCESS_CREATED' THEN coalesce(process_name, 'None') || ' started by ' || coalesce(parent_process, 'unknown parent') WHEN 'LOGIN_SUCCESS' THEN "user" || ' logged on'
  WHEN 'LOGIN_ATTEMPT' THEN 'failed logon of ' || "user" WHEN 'FILE_CREATED' THEN 'file ' || file_path || ' created' WHEN 'REGISTRY_MODIFIED' THEN 'registry key ' || file_path || ' modified'
  WHEN 'NETWORK_CONNECTION' THEN coalesce(process_name, 'process') || ' connected to ' || destination_ip || ':' || destination_port WHEN 'DNS_QUERY' THEN 'name ' || domain || ' looked up'
  WHEN 'PRIVILEGE_CHANGE' THEN 'privileges given to ' || "user" WHEN 'SERVICE_CREATED' THEN 'service installed: ' || file_path ELSE 'remote command from elsewhere' END || coalesce(' on ' || host, '')"""


@query("timeline", _chains(f"""SELECT me.chain, position::BIGINT AS seq, 'OBSERVED' AS kind, me.event_id, sec, event_type, coalesce(process_name, file_path, destination_ip, domain, "user", host) AS primary_entity, {_SAYS} AS summary,
  technique_id, relations, d.findings FROM me LEFT JOIN (SELECT event_id AS id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS findings FROM det GROUP BY event_id) d ON d.id = me.event_id
  LEFT JOIN (SELECT chain, substr(source, 7) AS id, string_agg(relation || ' ' || target, '; ' ORDER BY relation || ' ' || target) AS relations FROM ge WHERE source LIKE 'EVENT:%' AND relation <> 'PRECEDES' GROUP BY ALL) g ON g.id = me.event_id AND g.chain = me.chain
  UNION ALL SELECT chain, n + row_number() OVER (PARTITION BY chain ORDER BY confidence DESC, technique_id, kind), 'INFERRED', NULL, NULL, 'POSSIBLE_MISSING_STEP', technique_id, 'possible step in ' || tactic, technique_id, NULL, NULL
  FROM steps JOIN (SELECT chain, count(*) AS n FROM members GROUP BY chain) USING (chain)""", _GRAPH))  # fmt: skip
def timeline(spark, sf_dir):
    d = derived(spark, sf_dir)
    return graph.timeline(d.members, d.events, d.detections, d.steps).withColumn("seq", F.col("seq").cast("long"))


@query("network_view", _chains("""SELECT chain, count(*) FILTER (WHERE event_type = 'NETWORK_CONNECTION') AS connections, count(*) FILTER (WHERE event_type = 'DNS_QUERY') AS queries,
  coalesce(string_agg(DISTINCT destination_ip, ',' ORDER BY destination_ip), '') AS destinations, count(DISTINCT domain) AS domains FROM me GROUP BY chain"""))  # fmt: skip
def network_view(spark, sf_dir):
    d = derived(spark, sf_dir)
    return graph.network_view(d.members, d.events)


@query("network_rows", _chains("""SELECT chain, position, if(event_type = 'DNS_QUERY', 'QUERY', 'CONNECTION') AS kind, event_id, coalesce(destination_ip, domain) AS target, destination_port AS port, process_name AS process, host
  FROM me WHERE event_type IN ('NETWORK_CONNECTION', 'DNS_QUERY')"""))  # fmt: skip
def network_rows(spark, sf_dir):
    d = derived(spark, sf_dir)
    return graph.network_rows(d.members, d.events)


@query("network_graph", _chains("SELECT * FROM ge WHERE relation IN ('CONNECTED', 'PRECEDES') OR target LIKE 'IP:%' OR target LIKE 'DOMAIN:%'", _GRAPH))
def network_graph(spark, sf_dir):
    return graph.network_graph(derived(spark, sf_dir).graph)


@query("chain_rail", _chains("SELECT chain, chain_no, risk_level, confidence FROM ch ORDER BY is_attack DESC, risk DESC, confidence DESC, chain LIMIT 20"))
def chain_rail(spark, sf_dir):
    rail = derived(spark, sf_dir).chains.orderBy(F.desc("is_attack"), F.desc("risk"), F.desc("confidence"), "chain")
    return rail.limit(20).select("chain", "chain_no", "risk_level", "confidence")


@query("chain_report", _chains("""SELECT chain, events || ' events of ' || hosts || ' hosts and ' || users || ' accounts' || coalesce('|tactics: ' || replace(tactic_list, ',', ' -> '), '')
  || coalesce('|techniques: ' || array_to_string(string_split(technique_list, ',')[1:6], ', '), '') || coalesce('|possible gaps: ' || gaps, '') AS story,
  coalesce(found || '|', '') || printf('confidence %.1f', confidence) || '|risk ' || risk_level || ' ' || risk AS findings,
  concat_ws('|', CASE WHEN list_contains(tl, 'CREDENTIAL ACCESS') OR list_contains(tl, 'PRIVILEGE ESCALATION') THEN 'reset the accounts and read their logons' END, CASE WHEN list_contains(tl, 'PERSISTENCE') THEN 'check autostart keys, services and tasks' END,
  CASE WHEN list_contains(tl, 'COMMAND AND CONTROL') THEN 'block the destinations and look for beacons' END, CASE WHEN list_contains(tl, 'LATERAL MOVEMENT') THEN 'isolate the hosts and read remote service use' END,
  'confirm each finding in the raw records', 'hold the path against the coverage of techniques') AS advice
  FROM (SELECT *, coalesce(string_split(tactic_list, ','), []) AS tl FROM ch) LEFT JOIN (SELECT chain, string_agg(DISTINCT technique_id, ', ' ORDER BY technique_id) AS gaps FROM steps GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, string_agg(severity || ': ' || title, '|' ORDER BY r) AS found FROM (SELECT m.chain, severity, title, row_number() OVER (PARTITION BY m.chain ORDER BY severity DESC, position, rule_ord) AS r
  FROM members m JOIN det USING (event_id)) WHERE r <= 6 GROUP BY chain) USING (chain)"""))  # fmt: skip
def chain_report(spark, sf_dir):
    d = derived(spark, sf_dir)
    out = views.report(d.chains, C.chain_detections(d.members, d.detections), d.steps)
    return out.select("chain", _joined("story", "|"), _joined("findings", "|"), _joined("advice", "|"))


@query("chain_detail", _chains("""SELECT chain, chain_no, n_members, n_evidence, coalesce(n_steps, 0) AS n_steps, coalesce(n_stages, 0) AS n_stages, last_event, first_stage, events_in_order, facts, coalesce(gaps, '') AS gaps, coalesce(stages, '') AS stages FROM ch
  JOIN (SELECT chain, count(*) AS n_members, arg_max(event_id, position) AS last_event, string_agg(event_id, ',' ORDER BY position) AS events_in_order FROM members GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, count(*) AS n_evidence, string_agg(type || place || summary, ';' ORDER BY type, place, summary) AS facts FROM ev GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, count(*) AS n_steps, string_agg(kind || technique_id || tactic, ',' ORDER BY kind, technique_id, tactic) AS gaps FROM steps GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, count(*) AS n_stages, arg_min(tactic, place * 100 + sub) AS first_stage, string_agg(tactic, ',' ORDER BY place, sub) AS stages FROM path0 GROUP BY chain) USING (chain)""", EVIDENCE))  # fmt: skip
def chain_detail(spark, sf_dir):
    """Everything of a chain in one row; its lists are counted and spelled out here."""
    d = derived(spark, sf_dir)
    path = C.attack_path(d.members, d.events, d.steps).select("chain", "stage", "kind", "tactic", "technique_id")
    whole = views.chain_detail(d.chains, members=d.members.select("chain", "position", "event_id"), evidence=d.evidence.select("chain", "type", "place", "summary"), steps=d.steps, path=path)
    n = lambda c: F.size(c).cast("long").alias(f"n_{'stages' if c == 'path' else c}")
    return whole.select(
        "chain", "chain_no", n("members"), n("evidence"), n("steps"), n("path"), F.element_at("members", -1)["event_id"].alias("last_event"), F.get("path", 0)["tactic"].alias("first_stage"),
        F.array_join(F.transform("members", lambda m: m["event_id"]), ",").alias("events_in_order"), F.array_join(F.transform("evidence", lambda e: F.concat(e["type"], e["place"].cast("string"), e["summary"])), ";").alias("facts"),
        F.array_join(F.array_sort(F.transform("steps", lambda x: F.concat(x["kind"], x["technique_id"], x["tactic"]))), ",").alias("gaps"), F.array_join(F.transform("path", lambda x: x["tactic"]), ",").alias("stages"),
    )


@query("investigation_bundle", _chains(f"""SELECT ch.chain, n_timeline, coalesce(n_processes, 0) AS n_processes, coalesce(n_network, 0) AS n_network, summary, events_in_order, coalesce(process_names, '') AS process_names, coalesce(targets, '') AS targets FROM ch JOIN (SELECT chain, count(*) AS n_timeline, string_agg(event_id, ',' ORDER BY position) AS events_in_order FROM members GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, count(*) AS n_processes, string_agg(on_host || ':' || pid || ':' || process, ',' ORDER BY on_host, pid, process) AS process_names FROM nodes GROUP BY chain) USING (chain)
  LEFT JOIN (SELECT chain, count(*) AS n_network, string_agg(event_id || '>' || coalesce(if(event_type = 'DNS_QUERY', domain, destination_ip), ''), ',' ORDER BY position) AS targets FROM me WHERE event_type IN ('NETWORK_CONNECTION', 'DNS_QUERY') GROUP BY chain) USING (chain)
  JOIN (SELECT chain, {_SAYS} AS summary FROM me WHERE position = 1) USING (chain) WHERE is_attack""", _TREE))  # fmt: skip
def investigation_bundle(spark, sf_dir):
    """Timeline, processes, network and report of every attack chain as one nested row, here spelled out."""
    d = derived(spark, sf_dir)
    attacks = d.chains.where("is_attack").select("chain", "chain_no")
    mine = d.members.join(attacks.select("chain"), "chain", "left_semi")
    seen = graph.timeline(mine, d.events, d.detections).select("chain", "seq", "event_id", "summary")
    tree = graph.process_tree(mine, d.events).select("chain", "on_host", "pid", "process", "parent")
    whole = views.chain_detail(attacks, timeline=seen, processes=tree, network=graph.network_rows(mine, d.events))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    shown = F.transform("network", lambda x: F.concat(x["event_id"], F.lit(">"), F.coalesce(x["target"], F.lit(""))))
    names = F.transform("processes", lambda x: F.concat_ws(":", x["on_host"], x["pid"], x["process"]))
    return whole.select(
        "chain", n("timeline"), n("processes"), n("network"), F.get("timeline", 0)["summary"].alias("summary"), F.array_join(F.transform("timeline", lambda x: x["event_id"]), ",").alias("events_in_order"),
        F.array_join(names, ",").alias("process_names"), F.array_join(shown, ",").alias("targets"),
    )


@query("event_detail", _chains("""SELECT e.event_id, e.event_type, coalesce(rules, '') AS rules, chain, position, things, entities FROM e LEFT JOIN (SELECT event_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM det GROUP BY event_id) USING (event_id)
  LEFT JOIN (SELECT event_id, chain, position FROM members) USING (event_id) JOIN (SELECT event_id, len(listed)::BIGINT AS things, array_to_string(listed, ',') AS entities FROM (SELECT event_id, list_sort(list_distinct([x for x in ['HOST:' || host, 'USER:' || "user", 'IP:' || source_ip, 'IP:' || destination_ip, 'DOMAIN:' || domain,
  'FILE:' || file_path, 'PROCESS:' || coalesce(host || ':', '') || process_name, 'PROCESS:' || coalesce(host || ':', '') || parent_process, 'TECHNIQUE:' || technique_id] if x IS NOT NULL])) AS listed FROM e)) USING (event_id)"""))  # fmt: skip
def event_detail(spark, sf_dir):
    d = derived(spark, sf_dir)
    out = views.event_detail(d.events, d.detections, d.members)
    named = F.array_join(F.array_sort(F.transform("entities", lambda x: F.regexp_replace(x, ":[^:]*$", ""))), ",").alias("entities")
    return out.select("event_id", "event_type", _joined("rules"), "chain", "position", F.size("entities").cast("long").alias("things"), named)


_FEEDBACK = """log AS (SELECT chain, start_sec AS "at", CASE WHEN start_sec % 9 = 8 THEN 'maybe' WHEN start_sec % 9 % 3 = 0 THEN 'CONFIRMED' WHEN start_sec % 9 % 3 = 1 THEN 'CLOSED' ELSE 'INVESTIGATING' END AS status FROM ch
  UNION ALL SELECT chain, start_sec + 60, 'FALSE_POSITIVE' FROM ch WHERE start_sec % 9 < 4),
st AS (SELECT chain, chain_no, host_list, scn, is_attack, confidence, risk_level, coalesce(status, 'NEW') AS status, coalesce(entries, 0) AS entries FROM ch
  LEFT JOIN (SELECT chain, arg_max(status, "at") AS status, count(*) AS entries FROM log WHERE status <> 'maybe' GROUP BY chain) USING (chain)
  JOIN (SELECT chain, list(DISTINCT host) AS host_list, list(DISTINCT scenario_id) AS scn FROM me GROUP BY chain) USING (chain))"""


@query("chain_feedback", _chains("SELECT chain, status, entries FROM st", _FEEDBACK))
def chain_feedback(spark, sf_dir):
    d = derived(spark, sf_dir)
    judged, _ = views.apply_feedback(d.chains, d.feedback)
    return judged.select("chain", "status", F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("entries"))


@query("feedback_refused", _chains("SELECT chain, \"at\", status FROM log WHERE status = 'maybe'", _FEEDBACK))
def feedback_refused(spark, sf_dir):
    d = derived(spark, sf_dir)
    return views.apply_feedback(d.chains, d.feedback)[1].select("chain", "at", "status")


@query("chain_filter", _chains("SELECT chain, chain_no FROM st WHERE status = 'FALSE_POSITIVE' AND is_attack AND confidence >= 45 AND list_contains(scn, 'SCN-1')", _FEEDBACK))
def chain_filter(spark, sf_dir):
    d = derived(spark, sf_dir)
    judged, _ = views.apply_feedback(d.chains, d.feedback)
    scenarios = d.members.join(d.events.select("event_id", "scenario_id"), "event_id").groupBy("chain").agg(F.collect_set("scenario_id").alias("scenarios"))
    found = filters.filter_chains(judged.join(scenarios, "chain"), status="false_positive", is_attack=True, scenario_id="SCN-1", min_confidence=45)
    return found.select("chain", "chain_no")


@query("technique_chains", _chains("SELECT technique_id, count(*) AS n, min(chain) AS first_chain FROM chq GROUP BY technique_id"))
def technique_chains(spark, sf_dir):
    out = views.technique_chains(derived(spark, sf_dir).chains)
    return out.select("technique_id", F.size("chains").cast("long").alias("n"), F.get("chains", 0).alias("first_chain"))


@query("coverage", _chains("""SELECT t.tactic, t.idx, coalesce(string_agg(c.technique_id, ',' ORDER BY c.technique_id), '') AS techniques, coalesce(sum(c.n), 0)::BIGINT AS n_chains FROM (SELECT tactic, idx FROM tac UNION ALL SELECT 'UNKNOWN', 99) t
  LEFT JOIN (SELECT coalesce(tech.tactic, 'UNKNOWN') AS tactic, q.technique_id, count(DISTINCT chain) AS n FROM chq q LEFT JOIN tech USING (technique_id) GROUP BY ALL) c USING (tactic) GROUP BY ALL"""))  # fmt: skip
def coverage(spark, sf_dir):
    return views.coverage(derived(spark, sf_dir).chains)


@query("tactic_sizes", with_("""SELECT tac.tactic, tac.idx, count(tech.technique_id) AS catalog, count(d.technique_id) AS found FROM tac LEFT JOIN tech USING (tactic)
  LEFT JOIN (SELECT DISTINCT technique_id FROM det) d ON d.technique_id = tech.technique_id GROUP BY ALL""", DETECT))  # fmt: skip
def tactic_sizes(spark, sf_dir):
    return views.tactic_sizes(derived(spark, sf_dir).detections)


@query("kill_chain_bars", _chains("""SELECT s.stage, s.name, count(DISTINCT q.technique_id) AS techniques FROM (VALUES (1, 'Recon'), (2, 'Weaponization'), (3, 'Delivery'), (4, 'Exploitation'), (5, 'Installation'), (6, 'C2'), (7, 'Actions on Objectives')) s(stage, name)
  LEFT JOIN tac USING (stage) LEFT JOIN tech USING (tactic) LEFT JOIN chq q USING (technique_id) GROUP BY ALL"""))  # fmt: skip
def kill_chain_bars(spark, sf_dir):
    return views.kill_chain_bars(derived(spark, sf_dir).chains)


@query("kill_chain_listing", with_("""SELECT tac.tactic, tac.stage, s.name AS stage_name, count(d.event_id) AS findings FROM tac JOIN (VALUES (1, 'Recon'), (2, 'Weaponization'), (3, 'Delivery'), (4, 'Exploitation'), (5, 'Installation'), (6, 'C2'),
  (7, 'Actions on Objectives')) s(stage, name) USING (stage) LEFT JOIN det d USING (tactic) GROUP BY ALL""", DETECT))  # fmt: skip
def kill_chain_listing(spark, sf_dir):
    return views.kill_chain_listing(derived(spark, sf_dir).detections)


@query("technique_filter", with_("SELECT technique_id, name, tactic FROM tech WHERE technique_id IN (SELECT technique_id FROM det) AND tactic = 'PERSISTENCE'", DETECT))
def technique_filter(spark, sf_dir):
    """Catalog techniques of a tactic that detections found."""
    from chainspark.dims import techniques

    found = derived(spark, sf_dir).detections.select("technique_id")
    return filters.filter_techniques(techniques(spark).join(found, "technique_id", "left_semi"), tactic="persistence")


@query("technique_lookup", with_("SELECT DISTINCT t.technique_id, if(t.technique_id = 'T1078', 'Own name', t.name) AS name, t.tactic FROM tech t JOIN det d ON d.technique_id = t.technique_id", DETECT))
def technique_lookup(spark, sf_dir):
    """Techniques of detections by lower-case id: one of a stored table, the others of the catalog."""
    found = derived(spark, sf_dir).detections.select(F.lower("technique_id").alias("technique_id"))
    stored = found.where("technique_id = 't1078'").distinct().select("technique_id", F.lit("Own name").alias("name"), F.lit("PERSISTENCE").alias("tactic"))
    return filters.lookup_techniques(found, stored)


@query("store_stats", _chains("""SELECT 'severity' AS what, severity AS name, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'risk_level', risk_level, count(*) FROM st GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM st GROUP BY ALL""", _FEEDBACK))
def store_stats(spark, sf_dir):
    d = derived(spark, sf_dir)
    return views.store_stats(d.events, views.apply_feedback(d.chains, d.feedback)[0])


@query("stage_counts", _chains("""SELECT 'events' AS name, count(*) AS n FROM e UNION ALL SELECT 'detections', count(*) FROM det UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'members', count(*) FROM members
  UNION ALL SELECT 'chains', count(*) FROM ch UNION ALL SELECT 'steps', count(*) FROM steps UNION ALL SELECT 'evidence', count(*) FROM ev""", EVIDENCE))  # fmt: skip
def stage_counts(spark, sf_dir):
    d = derived(spark, sf_dir)
    names = ("events", "detections", "members", "chains", "steps", "evidence")
    for name in names:
        getattr(d, name)
    edges = d.kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("edges").alias("name"), "n")
    return d.store.rows(*names).unionByName(edges)


@query("by_scenario", _chains("""SELECT scenario_id, count(*) AS events, (SELECT count(*) FROM det JOIN p x USING (event_id) WHERE x.scenario_id = p.scenario_id) AS detections, coalesce(any_value(c.chains), 0) AS chains,
  coalesce(any_value(attacks), 0) AS attack_chains, coalesce(any_value(chain_list), '') AS chain_list FROM p LEFT JOIN (SELECT scenario_id, count(*) AS chains, count(*) FILTER (WHERE is_attack) AS attacks, string_agg(chain, ',' ORDER BY chain) AS chain_list
  FROM (SELECT DISTINCT me.scenario_id, ch.chain, is_attack FROM me JOIN ch USING (chain)) GROUP BY scenario_id) c USING (scenario_id) GROUP BY scenario_id"""))  # fmt: skip
def by_scenario(spark, sf_dir):
    d = derived(spark, sf_dir)
    return views.by_scenario(d.events, d.detections, d.members, d.chains)


@query("facets", with_("""SELECT DISTINCT 'host' AS facet, host AS value FROM p WHERE host IS NOT NULL UNION ALL SELECT DISTINCT 'user', "user" FROM p"""))
def facets(spark, sf_dir):
    return views.facets(derived(spark, sf_dir).telemetry)
