"""Evaluation against ground truth: set metrics, three stages, latency, deltas and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("raw_detection", "correlation", "reconstruction")
NO_TRUTH = "no ground truth: counts only"


def confusion(predicted: DataFrame, expected: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: tp, fp, fn of two item sets, with precision, recall and F1."""
    p = predicted.select(group, item).distinct().withColumn("p", F.lit(True))
    e = expected.select(group, item).distinct().withColumn("e", F.lit(True))
    both = p.join(e, [group, item], "full")
    hit = {"tp": F.col("p").isNotNull() & F.col("e").isNotNull(), "fp": F.col("e").isNull(), "fn": F.col("p").isNull()}
    return with_ratios(both.groupBy(group).agg(*[F.count_if(c).alias(n) for n, c in hit.items()]))


def with_ratios(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp and fn: null on a zero denominator, four places, F1 from the rounded two."""
    ratio = lambda of: F.bround(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(of)), 4)
    rows = rows.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))
    return rows.withColumn("f1", F.bround(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 4))


def stage_predictions(events: DataFrame, detections: DataFrame, clusters: DataFrame, members: DataFrame, chains: DataFrame) -> DataFrame:
    """``stage, scenario_id, level, item``: techniques and events that each stage flags, and ``alarm`` where it sees an attack.

    Raw detection flags the events of serious findings; correlation all events of clusters that hold
    a finding; reconstruction those of attack chains.  Events are named by their ground-truth tag.
    """
    tag = F.col("gt_id")
    of = events.select("event_id", "scenario_id", "gt_id", F.col("technique_id").alias("own_technique"))
    found = detections.select("event_id", "severity", "technique_id", "rule_ord").join(of, "event_id")
    first = found.groupBy("event_id").agg(F.min_by("technique_id", "rule_ord").alias("first_technique"))

    def rows(stage: str, df: DataFrame, level: str, item: Column) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), "scenario_id", F.lit(level).alias("level"), item.alias("item")).where("item is not null").distinct()

    serious = found.where(F.col("severity").isin("HIGH", "CRITICAL"))
    alarm = F.lit("alarm")
    out = [rows("raw_detection", found, "technique", F.col("technique_id")), rows("raw_detection", serious, "event", tag), rows("raw_detection", serious, "verdict", alarm)]
    struck = clusters.join(found.select("event_id").distinct(), "event_id", "left_semi").select("component").distinct()
    inside = clusters.join(struck, "component", "left_semi").join(of, "event_id").join(first, "event_id", "left")
    techniques = F.array_distinct(F.array_compact(F.array("first_technique", "own_technique")))
    out.append(rows("correlation", inside.withColumn("t", F.explode(techniques)), "technique", F.col("t")))
    out += [rows("correlation", inside, "event", tag), rows("correlation", inside, "verdict", alarm)]
    attacks = chains.where("is_attack").select("chain", "techniques")
    built = members.select("chain", "event_id").join(attacks, "chain").join(of, "event_id")
    out.append(rows("reconstruction", built.select("scenario_id", F.explode("techniques").alias("t")), "technique", F.col("t")))
    out += [rows("reconstruction", built, "event", tag), rows("reconstruction", built, "verdict", alarm)]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def scenario_results(predictions: DataFrame, truth: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``scenario_id, stage, level, tp, fp, fn, tn`` for every scenario, stage and level.

    ``truth`` is ``scenario_id, level, item`` and ``scenarios`` is ``scenario_id, is_benign``.  A benign
    scenario with nothing predicted or expected is one true negative.
    """
    spark = truth.sparkSession
    cells = spark.createDataFrame([(s, x) for s in STAGES for x in ("technique", "event")], "stage string, level string")
    grid = scenarios.select("scenario_id", "is_benign", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage")).join(F.broadcast(cells), "stage")
    stages = F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage")
    expected = truth.select("scenario_id", "level", "item").distinct().select("scenario_id", "level", "item", stages, F.lit(True).alias("e"))
    both = predictions.where("level <> 'verdict'").withColumn("p", F.lit(True)).join(expected, ["scenario_id", "stage", "level", "item"], "full")
    hit = {"tp": F.col("p") & F.col("e"), "fp": F.col("p") & F.col("e").isNull(), "fn": F.col("e") & F.col("p").isNull()}
    counted = both.groupBy("scenario_id", "stage", "level").agg(*[F.count_if(c).alias(n) for n, c in hit.items()])
    out = grid.join(counted, ["scenario_id", "stage", "level"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in hit})
    quiet = F.col("is_benign") & (F.col("tp") + F.col("fp") + F.col("fn") == 0)
    return out.withColumn("tn", quiet.cast("long"))


def verdicts(predictions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``scenario_id, stage, is_benign, attack_detected, correct``."""
    alarms = predictions.where("level = 'verdict'").select("scenario_id", "stage").distinct().withColumn("alarm", F.lit(True))
    grid = scenarios.select("scenario_id", "is_benign", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    out = grid.join(alarms, ["scenario_id", "stage"], "left").withColumn("attack_detected", F.coalesce("alarm", F.lit(False))).drop("alarm")
    return out.withColumn("correct", F.col("attack_detected") != F.col("is_benign"))


def overall(results: DataFrame) -> DataFrame:
    """``stage, level``: sums over scenarios with precision, recall and F1."""
    return with_ratios(results.groupBy("stage", "level").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def attack_detection(found: DataFrame) -> DataFrame:
    """``stage, tp, fp, fn, tn`` over scenario verdicts, with ratios and the false-positive rate."""
    seen, benign = F.col("attack_detected"), F.col("is_benign")
    cells = {"tp": seen & ~benign, "fp": seen & benign, "fn": ~seen & ~benign, "tn": ~seen & benign}
    out = with_ratios(found.groupBy("stage").agg(*[F.count_if(c).alias(n) for n, c in cells.items()]))
    return out.withColumn("false_positive_rate", F.bround(F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")), 4))


def latency(events: DataFrame, detections: DataFrame, truth: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``scenario_id, seconds``: from the first event of the ground truth to the first detection, not below zero; attacks only."""
    tagged = truth.where("level = 'event'").select("scenario_id", F.col("item").alias("gt_id"))
    began = events.join(tagged, ["scenario_id", "gt_id"]).groupBy("scenario_id").agg(F.min("sec").alias("began"))
    seen = detections.select("event_id").distinct().join(events, "event_id").groupBy("scenario_id").agg(F.min("sec").alias("seen"))
    both = began.join(seen, "scenario_id").join(scenarios.where("not is_benign").select("scenario_id"), "scenario_id")
    return both.select("scenario_id", F.greatest(F.lit(0), F.col("seen") - F.col("began")).cast("double").alias("seconds")).where("seconds is not null")


def chain_scores(members: DataFrame, chains: DataFrame, events: DataFrame, truth: DataFrame) -> DataFrame:
    """``scenario_id, chains, attack_chains, chain_f1``: the best F1 of an attack chain's events against the scenario's.

    A chain belongs to the scenario of most of its events (ties: the first by name).
    """
    of = members.select("chain", "event_id").join(events.select("event_id", "scenario_id", "gt_id"), "event_id")
    size = of.groupBy("chain", "scenario_id").agg(F.count(F.lit(1)).alias("n"))
    home = size.groupBy("chain").agg(F.min(F.struct((-F.col("n")).alias("down"), "scenario_id")).alias("m")).select("chain", "m.scenario_id")
    wanted = truth.where("level = 'event'").select("scenario_id", F.col("item").alias("gt_id")).distinct()
    total = wanted.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("wanted"))
    tagged = of.select("chain", "gt_id").where("gt_id is not null").distinct().join(home, "chain")
    hit = tagged.join(wanted.withColumn("hit", F.lit(1)), ["scenario_id", "gt_id"], "left").groupBy("chain", "scenario_id").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("held"))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("held") + F.col("wanted"))
    scored = home.join(chains.select("chain", "is_attack"), "chain").join(hit, ["chain", "scenario_id"], "left").join(total, "scenario_id", "left")
    best = F.bround(F.max(F.when(F.col("is_attack") & F.col("wanted").isNotNull(), F.coalesce(f1, F.lit(0.0)))), 4)
    return scored.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("chains"), F.count_if("is_attack").alias("attack_chains"), best.alias("chain_f1"))


def summary(chain_rows: DataFrame, delays: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row: latency mean, max and samples; chains, chains reconstructed correctly (F1 of 0.5 or more), and accuracy."""
    delay = delays.agg(F.bround(F.avg("seconds"), 3).alias("latency_mean"), F.bround(F.max("seconds"), 3).alias("latency_max"), F.count("seconds").alias("latency_samples"))
    of = scenarios.join(chain_rows, "scenario_id", "left")
    right = F.count_if(~F.col("is_benign") & (F.coalesce("chain_f1", F.lit(0.0)) >= 0.5))
    built = of.agg(F.coalesce(F.sum("chains"), F.lit(0)).cast("long").alias("chains"), right.alias("correct_chains"), F.count(F.lit(1)).alias("scenarios"))
    built = built.withColumn("chain_accuracy", F.bround(F.try_divide(F.col("correct_chains").cast("double"), F.col("chains")), 4))
    value = lambda c: delay.select(c).scalar().alias(c)
    return built.select("*", *[value(c) for c in ("latency_mean", "latency_max", "latency_samples")])


def deltas(rows: DataFrame) -> DataFrame:
    """``run_id, level, stage, f1, delta``: each stage's F1 less that of raw detection, of every run."""
    raw = rows.where("stage = 'raw_detection'").select("run_id", "level", F.col("f1").alias("raw_f1"))
    return rows.join(raw, ["run_id", "level"]).select("run_id", "level", "stage", "f1", F.bround(F.col("f1") - F.col("raw_f1"), 4).alias("delta"))


def latest(runs: DataFrame) -> DataFrame:
    """Rows of the run that was created last."""
    last = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return runs.join(F.broadcast(last), "run_id")


def history(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Runs, newest first, a page at a time (the feature)."""
    return runs.select("run_id", "created_at", "events").distinct().orderBy(F.desc("created_at"), F.desc("run_id")).offset(offset).limit(limit)


def with_policy(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics only for scenarios that have ground truth; the others carry a note instead."""
    known = truth.select("scenario_id").distinct().withColumn("known", F.lit(True))
    rows = results.join(known, "scenario_id", "left")
    kept = {c: F.when(F.col("known"), F.col(c)) for c in ("precision", "recall", "f1")}
    return with_ratios(rows).withColumns(kept).withColumn("note", F.when(F.col("known").isNull(), F.lit(NO_TRUTH))).drop("known")
