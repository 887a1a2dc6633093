"""Queries of indicator feeds, evaluation and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.operators import chains as C
from chainspark.operators import evaluate, indicators, rules
from chainspark.plans.oracle_parts import CHAINS, CORRELATE, CROSSED, DETECT, P, isolated, reach, with_
from chainspark.plans.queries import query
from chainspark.plans.stored import Derived, derived
from chainspark.sinks import tables

# ------------------------------------------------------------- indicators


def feed(events: DataFrame) -> DataFrame:
    """Indicators of addresses and domains that events met and whose length divides by three, and as many that none met."""
    third = lambda c: F.length(c) % 3 == 0
    ips = events.where(F.col("destination_ip").isNotNull() & third("destination_ip")).select(F.col("destination_ip").alias("value"), F.lit("ip").alias("type"))
    names = events.where(F.col("domain").isNotNull() & third("domain")).select(F.upper("domain").alias("value"), F.lit("unknown").alias("type"))
    both = ips.unionByName(names).distinct()
    both = both.unionByName(both.where("type = 'ip'").select(F.concat(F.lit("9"), F.col("value")).alias("value"), F.lit("sha1").alias("type")))
    return both.select(F.xxhash64("value").alias("idx"), "type", "value", F.lit("feed").alias("source"))


_MATCHES = """im AS (SELECT event_id, 'destination_ip' AS field, 'ip' AS type, destination_ip AS value, 'feed' AS source, 'MEDIUM' AS severity FROM p WHERE destination_ip IS NOT NULL AND length(destination_ip) % 3 = 0
  UNION ALL SELECT event_id, 'domain', 'domain', domain, 'feed', 'MEDIUM' FROM p WHERE domain IS NOT NULL AND length(domain) % 3 = 0)"""


def _matches(d: Derived) -> DataFrame:
    return d.store.table("matches", lambda: indicators.match(d.telemetry, indicators.indicators(feed(d.telemetry))))


@query("ioc_matches", with_("SELECT * FROM im", _MATCHES))
def ioc_matches(spark, sf_dir):
    return _matches(derived(spark, sf_dir))


@query("ioc_detections", with_("""SELECT event_id, rule_ord, rule_id, severity, title FROM det UNION ALL SELECT event_id, 18, 'IOC_MATCH', severity, 'Indicator seen: ' || value FROM im""", DETECT, _MATCHES))
def ioc_detections(spark, sf_dir):
    """All findings, those of the rules and those of indicators."""
    d = derived(spark, sf_dir)
    both = d.detections.unionByName(indicators.as_detections(_matches(d)))
    return both.select("event_id", "rule_ord", "rule_id", "severity", "title")


@query("ioc_new", with_("SELECT event_id, value, source, type FROM im WHERE right(event_id, 1) <> '3'", _MATCHES))
def ioc_new(spark, sf_dir):
    """A second import, after the matches of some events were stored."""
    found = _matches(derived(spark, sf_dir))
    known = found.where(F.col("event_id").endswith("3"))
    return indicators.new_matches(found.unionByName(found), known).select("event_id", "value", "source", "type")


@query("ioc_evidence", with_("SELECT chain, event_id, 'indicator ' || type || ' ' || value || ' of feed' AS summary FROM im JOIN members USING (event_id) WHERE right(event_id, 1) <> '3'", DETECT, CORRELATE, CHAINS, _MATCHES, recursive=True))
def ioc_evidence(spark, sf_dir):
    d = derived(spark, sf_dir)
    none = spark.createDataFrame([], "chain string, event_id string, summary string")
    known = indicators.chain_matches(_matches(d).where(F.col("event_id").endswith("3")), d.members, none)
    return indicators.chain_matches(_matches(d), d.members, known)


@query("ioc_report", with_("""SELECT l.type, l.n AS indicators, coalesce(m.n, 0) AS matches, coalesce(m.fresh, 0) AS created, coalesce(m.n - m.fresh, 0) AS duplicates FROM (SELECT type, count(DISTINCT lower(value)) AS n FROM (SELECT type, value FROM im
  UNION ALL SELECT 'hash', '9' || value FROM im WHERE type = 'ip') GROUP BY type) l LEFT JOIN (SELECT type, count(*) AS n, count(*) FILTER (WHERE right(event_id, 1) <> '3') AS fresh FROM im GROUP BY type) m USING (type)""", _MATCHES))  # fmt: skip
def ioc_report(spark, sf_dir):
    d = derived(spark, sf_dir)
    found = _matches(d)
    fresh = indicators.new_matches(found, found.where(F.col("event_id").endswith("3")))
    return indicators.import_report(indicators.indicators(feed(d.telemetry)), found, fresh)


@query("ioc_top", with_("SELECT event_id, value FROM im ORDER BY event_id, value LIMIT 100", _MATCHES))
def ioc_top(spark, sf_dir):
    """The first hundred matches, as a report lists them."""
    return _matches(derived(spark, sf_dir)).select("event_id", "value").orderBy("event_id", "value").limit(100)


def _feed_files(d: Derived) -> DataFrame:
    """A feed file of one of six forms for every block of 500 events, with values of those events."""
    n = F.substring("event_id", 5, 12).cast("long")
    rows = d.telemetry.where("destination_ip is not null").select(F.floor(n / 500).alias("blk"), n.alias("n"), F.col("destination_ip").alias("v"))
    value = lambda c: F.transform("vs", c)
    grouped = rows.groupBy("blk").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("vs"))
    form = F.col("blk") % 6
    lines = lambda head, c: F.concat(F.lit(head), F.array_join(value(c), "\n"))
    text = (
        F.when(form == 0, lines("﻿Type,Indicator,Feed\n", lambda v: F.concat(F.lit('ipv4,"'), v, F.lit('",listed'))))
        .when(form == 1, lines("", lambda v: F.concat(v, F.lit(",beside"))))
        .when(form == 2, lines("kind,color\n", lambda v: F.concat(F.lit("ip,"), v)))
        .when(form == 3, F.to_json(F.struct(F.lit("bundle").alias("type"), value(lambda v: F.struct(F.lit("indicator").alias("type"), F.concat(F.lit("[ipv4-addr:value = '"), v, F.lit("' OR domain-name:value = 'Bad."), F.lit("example.com']")).alias("pattern"), F.lit("stix feed").alias("name"))).alias("objects"))))
        .when(form == 4, F.concat(F.lit("["), F.array_join(value(lambda v: F.concat(F.lit('{"observable": "'), v, F.lit('", "source": "list"}'))), ","), F.lit(', {"value": ""}, {"value": "what is this"}]')))
        .otherwise(F.lit('{"type": "report"}'))
    )
    return grouped.select(F.concat_ws("-", F.lit("feed"), F.col("blk").cast("string")).alias("file"), text.alias("text"))


_FEEDS = """fb AS (SELECT substr(event_id, 5)::BIGINT // 500 AS blk, destination_ip AS v FROM p WHERE destination_ip IS NOT NULL),
fr AS (SELECT blk, blk % 6 AS form, v FROM fb)"""


@query("ioc_feeds", with_("""SELECT type, key, source, min(value) AS value FROM (SELECT 'ip' AS type, v AS key, v AS value, CASE form WHEN 0 THEN 'listed' WHEN 1 THEN 'beside' WHEN 3 THEN 'stix feed' ELSE 'list' END AS source FROM fr WHERE form IN (0, 1, 3, 4)
  UNION ALL SELECT 'domain', 'bad.example.com', 'Bad.example.com', 'stix feed' FROM fr WHERE form = 3) GROUP BY ALL""", _FEEDS))  # fmt: skip
def ioc_feeds(spark, sf_dir):
    """Feed files of CSV, STIX and JSON forms, sniffed, parsed and validated to one indicator table."""
    rows, _ = indicators.parse_feeds(_feed_files(derived(spark, sf_dir)))
    return indicators.indicators(rows).select("type", "key", "source", "value")


@query("ioc_issues", with_("""SELECT field, message, count(*) AS n FROM (SELECT 'header' AS field, 'no value column' AS message FROM (SELECT DISTINCT blk FROM fr WHERE form = 2) UNION ALL SELECT 'file', 'neither a bundle nor a list' FROM (SELECT DISTINCT blk FROM fr WHERE form = 5)
  UNION ALL SELECT 'value', unnest(['empty value', 'type cannot be told']) FROM (SELECT DISTINCT blk FROM fr WHERE form = 4)) GROUP BY ALL""", _FEEDS))  # fmt: skip
def ioc_issues(spark, sf_dir):
    rows, issues = indicators.parse_feeds(_feed_files(derived(spark, sf_dir)))
    both = issues.unionByName(indicators.feed_issues(rows).where("message <> 'repeated'"))
    return both.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- evaluation


def _scenarios(telemetry: DataFrame) -> DataFrame:
    """The last scenario counts as benign."""
    return telemetry.select("scenario_id").distinct().withColumn("is_benign", F.col("scenario_id") == "SCN-5")


def _truth(telemetry: DataFrame) -> DataFrame:
    """What the attack scenarios are made of: remote executions, services and tools run by their accounts, with their techniques."""
    attack = telemetry.where("scenario_id <> 'SCN-5' and event_type in ('REMOTE_EXECUTION', 'SERVICE_CREATED', 'PRIVILEGE_CHANGE')")
    technique = F.when(F.col("event_type") == "SERVICE_CREATED", "T1543.003").when(F.col("event_type") == "PRIVILEGE_CHANGE", "T1078").otherwise("T1021.002")
    events = attack.select("scenario_id", F.lit("event").alias("level"), F.col("event_id").alias("item"))
    return events.unionByName(attack.select("scenario_id", F.lit("technique").alias("level"), technique.alias("item")).distinct())


_APART = ("scenario_id",)


class Evaluated:
    """Every stage run with scenarios apart: counting rules, enrichment, edges, clusters and chains see one scenario at a time.

    All scenarios go through one pass, the scenario in every key.  With ``crossed``, the scenarios take
    turns every sixteen events, so that accounts and hosts stand in several.
    """

    def __init__(self, d: Derived, crossed: bool = False):
        self.d, self.prefix = d, f"eval_{'crossed_' * crossed}"
        self.telemetry = d.telemetry
        if crossed:
            turn = F.floor(F.substring("event_id", 5, 12).cast("long") / 16) % 6
            self.telemetry = d.telemetry.withColumn("scenario_id", F.concat(F.lit("SCN-"), turn.cast("string")))
        self.scenarios, self.truth = _scenarios(self.telemetry), _truth(self.telemetry)

    def _table(self, name: str, make) -> DataFrame:
        """Built when a query first asks for it, so that findings alone wait for no edges."""
        return self.d.store.table(self.prefix + name, make)

    @property
    def detections(self) -> DataFrame:
        return self._table("detections", lambda: rules.detect(self.telemetry, isolate_by=_APART))

    @property
    def events(self) -> DataFrame:
        return self._table("events", lambda: rules.enrich(self.telemetry, self.detections))

    def prepared(self) -> DataFrame:
        return self._table("prepared", lambda: C.prepared(self.events, isolate_by=_APART))

    @property
    def clusters(self) -> DataFrame:
        return self._table("clusters", lambda: C.clusters(self.events, isolate_by=_APART, rows=self.prepared))

    @property
    def members(self) -> DataFrame:
        return self._table("members", lambda: C.linked_members(self.events, isolate_by=_APART, rows=self.prepared))

    @property
    def chains(self) -> DataFrame:
        # A chain is of one scenario, so its edges are those of the scenario.
        conf = lambda: C.confidence_of(C.tally(self.events, self.members, rows=self.prepared))
        return self._table("chains", lambda: C.verdicts(C.roll_up(self.members, self.events, self.detections), conf()))

    @property
    def tagged(self) -> DataFrame:
        """A scenario run's events, each tagged with its own id."""
        return self.events.withColumn("gt_id", F.col("event_id"))

    @property
    def predictions(self) -> DataFrame:
        return self._table("predictions", lambda: evaluate.stage_predictions(self.tagged, self.detections, self.clusters, self.members, self.chains))

    @property
    def results(self) -> DataFrame:
        return evaluate.scenario_results(self.predictions, self.truth, self.scenarios)

    @property
    def verdicts(self) -> DataFrame:
        return evaluate.verdicts(self.predictions, self.scenarios)


_EVAL = (
    "eiso AS MATERIALIZED (SELECT x.* FROM edges x JOIN p a ON a.event_id = x.event_a JOIN p b ON b.event_id = x.event_b WHERE a.scenario_id = b.scenario_id),\n"
    + reach("ecl", "eiso")
    + ",\n"
    + CHAINS.replace("FROM edges", "FROM eiso")
    + """,
scn AS (SELECT DISTINCT scenario_id, scenario_id = 'SCN-5' AS is_benign FROM p),
gt AS (SELECT scenario_id, 'event' AS level, event_id AS item FROM p WHERE scenario_id <> 'SCN-5' AND event_type IN ('REMOTE_EXECUTION', 'SERVICE_CREATED', 'PRIVILEGE_CHANGE')
  UNION SELECT scenario_id, 'technique', CASE event_type WHEN 'SERVICE_CREATED' THEN 'T1543.003' WHEN 'PRIVILEGE_CHANGE' THEN 'T1078' ELSE 'T1021.002' END FROM p
  WHERE scenario_id <> 'SCN-5' AND event_type IN ('REMOTE_EXECUTION', 'SERVICE_CREATED', 'PRIVILEGE_CHANGE')),
struck AS (SELECT DISTINCT component FROM ecl WHERE event_id IN (SELECT event_id FROM det)),
inside AS (SELECT x.* FROM ecl JOIN struck USING (component) JOIN (SELECT e.*, f.technique_id AS first_technique FROM e LEFT JOIN (SELECT event_id, arg_min(technique_id, rule_ord) AS technique_id FROM det GROUP BY event_id) f USING (event_id)) x USING (event_id)),
pred AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT 'raw_detection' AS stage, scenario_id, 'technique' AS level, d.technique_id AS item FROM det d JOIN p USING (event_id) UNION ALL SELECT 'raw_detection', scenario_id, 'event', event_id FROM det d JOIN p USING (event_id) WHERE d.severity IN ('HIGH', 'CRITICAL')
  UNION ALL SELECT 'correlation', scenario_id, 'technique', first_technique FROM inside UNION ALL SELECT 'correlation', scenario_id, 'technique', technique_id FROM inside UNION ALL SELECT 'correlation', scenario_id, 'event', event_id FROM inside
  UNION ALL SELECT 'reconstruction', me.scenario_id, 'technique', q.technique_id FROM ch JOIN chq q USING (chain) JOIN me USING (chain) WHERE is_attack UNION ALL SELECT 'reconstruction', me.scenario_id, 'event', event_id FROM ch JOIN me USING (chain) WHERE is_attack) WHERE item IS NOT NULL),
stg AS (SELECT unnest(['raw_detection', 'correlation', 'reconstruction']) AS stage),
cellz AS (SELECT scenario_id, is_benign, stage, level FROM scn, stg, (VALUES ('technique'), ('event')) v(level)),
res AS MATERIALIZED (SELECT scenario_id, is_benign, stage, level, hit AS tp, said - hit AS fp, wanted - hit AS fn FROM (SELECT c.*, (SELECT count(*) FROM pred x JOIN gt USING (scenario_id, level, item) WHERE x.scenario_id = c.scenario_id AND x.stage = c.stage AND x.level = c.level) AS hit,
  (SELECT count(*) FROM pred x WHERE x.scenario_id = c.scenario_id AND x.stage = c.stage AND x.level = c.level) AS said, (SELECT count(*) FROM gt x WHERE x.scenario_id = c.scenario_id AND x.level = c.level) AS wanted FROM cellz c)),
ver AS (SELECT scenario_id, stage, is_benign, EXISTS (SELECT 1 FROM pred x WHERE x.scenario_id = c.scenario_id AND x.stage = c.stage AND x.level = 'event') AS attack_detected FROM (SELECT DISTINCT scenario_id, stage, is_benign FROM cellz) c),
tot AS (SELECT stage, level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM res GROUP BY ALL)"""
)


def _ratios(rows: str) -> str:
    return f"""SELECT *, round_even(2 * "precision" * recall / nullif("precision" + recall, 0), 4) AS f1 FROM (SELECT *, round_even(tp / nullif(tp + fp, 0), 4) AS "precision", round_even(tp / nullif(tp + fn, 0), 4) AS recall FROM ({rows}))"""


def _eval(select: str, crossed: bool = False) -> str:
    return with_(select, isolated(DETECT), CORRELATE, _EVAL, recursive=True, p=CROSSED if crossed else P)


@query("eval_scenarios", _eval(_ratios("SELECT scenario_id, is_benign, stage, level, tp, fp, fn, (is_benign AND tp + fp + fn = 0)::BIGINT AS tn FROM res")))
def eval_scenarios(spark, sf_dir):
    return evaluate.with_ratios(Evaluated(derived(spark, sf_dir)).results)


@query("eval_overall", _eval(_ratios("SELECT * FROM tot")))
def eval_overall(spark, sf_dir):
    return evaluate.overall(Evaluated(derived(spark, sf_dir)).results)


@query("eval_verdicts", _eval("SELECT scenario_id, stage, is_benign, attack_detected, attack_detected <> is_benign AS correct FROM ver"))
def eval_verdicts(spark, sf_dir):
    return Evaluated(derived(spark, sf_dir)).verdicts


@query("eval_detection", _eval("SELECT *, round_even(fp / nullif(fp + tn, 0), 4) AS false_positive_rate FROM (" + _ratios("""SELECT stage, count(*) FILTER (WHERE attack_detected AND NOT is_benign) AS tp, count(*) FILTER (WHERE attack_detected AND is_benign) AS fp,
  count(*) FILTER (WHERE NOT attack_detected AND NOT is_benign) AS fn, count(*) FILTER (WHERE NOT attack_detected AND is_benign) AS tn FROM ver GROUP BY stage""") + ")"))  # fmt: skip
def eval_detection(spark, sf_dir):
    return evaluate.attack_detection(Evaluated(derived(spark, sf_dir)).verdicts)


_LATENCY = """SELECT scenario_id, greatest(0, min(sec) FILTER (WHERE event_id IN (SELECT event_id FROM det)) - min(sec) FILTER (WHERE event_id IN (SELECT item FROM gt)))::DOUBLE AS seconds FROM p WHERE scenario_id <> 'SCN-5' GROUP BY scenario_id"""


@query("eval_latency", _eval(_LATENCY))
def eval_latency(spark, sf_dir):
    e = Evaluated(derived(spark, sf_dir))
    return evaluate.latency(e.tagged, e.detections, e.truth, e.scenarios)


_CHAIN_F1 = """SELECT scenario_id, count(*) AS chains, count(*) FILTER (WHERE is_attack) AS attack_chains, round_even(max(CASE WHEN is_attack AND wanted > 0 THEN 2.0 * tp / (held + wanted) END), 4) AS chain_f1 FROM (
  SELECT me.scenario_id, ch.chain, is_attack, count(*) AS held, count(*) FILTER (WHERE event_id IN (SELECT item FROM gt)) AS tp, (SELECT count(*) FROM gt WHERE gt.scenario_id = me.scenario_id AND level = 'event') AS wanted FROM me JOIN ch USING (chain) GROUP BY ALL) GROUP BY scenario_id"""


@query("eval_chains", _eval(_CHAIN_F1))
def eval_chains(spark, sf_dir):
    e = Evaluated(derived(spark, sf_dir))
    return evaluate.chain_scores(e.members, e.chains, e.tagged, e.truth)


@query("eval_summary", _eval(f"""SELECT sum(coalesce(chains, 0))::BIGINT AS chains, count(*) FILTER (WHERE NOT is_benign AND coalesce(chain_f1, 0) >= 0.5) AS correct_chains, count(*) AS scenarios, round_even(correct_chains / nullif(sum(chains), 0), 4) AS chain_accuracy,
  (SELECT round_even(avg(seconds), 3) FROM ({_LATENCY})) AS latency_mean, (SELECT round_even(max(seconds), 3) FROM ({_LATENCY})) AS latency_max, (SELECT count(seconds) FROM ({_LATENCY})) AS latency_samples FROM scn LEFT JOIN ({_CHAIN_F1}) USING (scenario_id)"""))  # fmt: skip
def eval_summary(spark, sf_dir):
    e = Evaluated(derived(spark, sf_dir))
    delays = evaluate.latency(e.tagged, e.detections, e.truth, e.scenarios)
    return evaluate.summary(evaluate.chain_scores(e.members, e.chains, e.tagged, e.truth), delays, e.scenarios)


@query("eval_crossed", _eval("SELECT scenario_id, is_benign, stage, level, tp, fp, fn FROM res", crossed=True))
def eval_crossed(spark, sf_dir):
    """Scenarios whose accounts and hosts cross: each is judged as if it ran alone."""
    return Evaluated(derived(spark, sf_dir), crossed=True).results.select("scenario_id", "is_benign", "stage", "level", "tp", "fp", "fn")


@query("eval_crossed_findings", with_("SELECT scenario_id, rule_id, count(*) AS n FROM det JOIN p USING (event_id) GROUP BY ALL", isolated(DETECT), p=CROSSED))
def eval_crossed_findings(spark, sf_dir):
    e = Evaluated(derived(spark, sf_dir), crossed=True)
    return e.detections.join(e.telemetry.select("event_id", "scenario_id"), "event_id").groupBy("scenario_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("eval_crossed_chains", _eval(_CHAIN_F1, crossed=True))
def eval_crossed_chains(spark, sf_dir):
    e = Evaluated(derived(spark, sf_dir), crossed=True)
    return evaluate.chain_scores(e.members, e.chains, e.tagged, e.truth)


@query("eval_policy", _eval("SELECT scenario_id, stage, level, tp, fp, fn, if(is_benign, NULL, f1) AS f1, if(is_benign, 'no ground truth: counts only', NULL) AS note FROM (" + _ratios("SELECT scenario_id, is_benign, stage, level, tp, fp, fn FROM res") + ")"))
def eval_policy(spark, sf_dir):
    """The benign scenario has no ground truth, so it gets counts and a note."""
    e = Evaluated(derived(spark, sf_dir))
    return evaluate.with_policy(e.results, e.truth).select("scenario_id", "stage", "level", "tp", "fp", "fn", "f1", "note")


def _runs(e: Evaluated) -> DataFrame:
    """Three runs appended one by one: all scenarios, then without the first, then without the first two."""
    path = e.d.store.path("runs")

    def write(_: str) -> None:
        for i in range(3):
            rows = evaluate.overall(e.results.where(F.col("scenario_id") >= f"SCN-{i}"))
            n = e.d.telemetry.where(F.col("scenario_id") >= f"SCN-{i}").agg(F.count(F.lit(1))).scalar()
            tables.append_run(path, rows.select(F.lit(i + 1).alias("run_id"), F.lit(1000 + i).alias("created_at"), n.alias("events"), "stage", "level", "f1"))

    e.d.store.files("runs", write)
    return tables.read_runs(e.d.spark, path)


_RUNS = ", ".join(f"run{i} AS ({_ratios(f'SELECT stage, level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM res WHERE scenario_id >= {chr(39)}SCN-{i}{chr(39)} GROUP BY ALL')})" for i in range(3))
_ALL_RUNS = "runs AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS run_id, {1000 + i} AS created_at, (SELECT count(*) FROM p WHERE scenario_id >= 'SCN-{i}') AS events, stage, level, f1 FROM run{i}" for i in range(3)) + ")"


@query("run_deltas", with_("SELECT r.run_id, r.level, r.stage, r.f1, round_even(r.f1 - x.f1, 4) AS delta FROM runs r JOIN runs x ON x.run_id = r.run_id AND x.level = r.level AND x.stage = 'raw_detection'", isolated(DETECT), CORRELATE, _EVAL, _RUNS, _ALL_RUNS, recursive=True))
def run_deltas(spark, sf_dir):
    return evaluate.deltas(_runs(Evaluated(derived(spark, sf_dir))))


@query("run_latest", with_("SELECT * FROM runs WHERE run_id = 3", isolated(DETECT), CORRELATE, _EVAL, _RUNS, _ALL_RUNS, recursive=True))
def run_latest(spark, sf_dir):
    return evaluate.latest(_runs(Evaluated(derived(spark, sf_dir))))


@query("run_history", with_("SELECT DISTINCT run_id, created_at, events FROM runs ORDER BY created_at DESC LIMIT 2", isolated(DETECT), CORRELATE, _EVAL, _RUNS, _ALL_RUNS, recursive=True))
def run_history(spark, sf_dir):
    return evaluate.history(_runs(Evaluated(derived(spark, sf_dir))), 2)


@query("eval_confusion", with_("""SELECT scenario_id, tp, fp, fn, round_even(tp / nullif(tp + fp, 0), 4) AS "precision", round_even(tp / nullif(tp + fn, 0), 4) AS recall,
  round_even(2 * round_even(tp / nullif(tp + fp, 0), 4) * round_even(tp / nullif(tp + fn, 0), 4) / nullif(round_even(tp / nullif(tp + fp, 0), 4) + round_even(tp / nullif(tp + fn, 0), 4), 0), 4) AS f1 FROM (
  SELECT scenario_id, count(*) FILTER (WHERE h AND g) AS tp, count(*) FILTER (WHERE h AND NOT g) AS fp, count(*) FILTER (WHERE NOT h AND g) AS fn
  FROM (SELECT scenario_id, event_id IN (SELECT event_id FROM det WHERE severity IN ('HIGH', 'CRITICAL')) AS h, severity IN ('MEDIUM', 'HIGH') AS g FROM p) WHERE h OR g GROUP BY scenario_id)""", DETECT))  # fmt: skip
def eval_confusion(spark, sf_dir):
    d = derived(spark, sf_dir)
    serious = d.detections.where(F.col("severity").isin("HIGH", "CRITICAL")).select("event_id").distinct()
    predicted = d.telemetry.join(serious, "event_id", "left_semi")
    return evaluate.confusion(predicted, d.telemetry.where(F.col("severity").isin("MEDIUM", "HIGH")), "scenario_id", "event_id")
