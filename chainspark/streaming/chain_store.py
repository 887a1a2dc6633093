"""Chains kept up to date by micro-batches: what a batch writes follows the batch and the chains it touches.

Three tables grow by one folder a batch, and of equal keys the latest folder counts: ``events`` (enriched,
also earlier ones whose findings a batch has changed), ``edges`` (``live`` false where one fell away) and
``labels`` (an event's chain, null where it left one).  A batch that is repeated after a failure
reads only the folders before it and writes its own again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.config import DEFAULT, Settings
from chainspark.functions.scalars import filled
from chainspark.operators.components import components
from chainspark.operators.correlate import candidates, edges_of, entity_keys, score_pairs
from chainspark.operators.rules import authentication, detect, enrich
from chainspark.sinks.store import cut

KEYS = {"events": ["event_id"], "edges": ["event_a", "event_b"], "labels": ["event_id"]}
_FOUND = ("technique_id", "technique_name", "tactic", "findings")


class ChainStore:
    def __init__(self, spark: SparkSession, path: str, cfg: Settings = DEFAULT):
        self.spark, self.path, self.cfg = spark, path, cfg

    def _folders(self, name: str, below: int | None) -> DataFrame | None:
        """Rows of a table by all batches, or by those before ``below``; None where there are none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if below is None else rows.where(F.col("batch") < below)

    def current(self, name: str, below: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """Latest rows of a table; ``only`` (a table of keys) reduces what is read before versions are compared."""
        rows = self._folders(name, below)
        if rows is None:
            return None
        key = KEYS[name]
        rows = rows if only is None else rows.join(only, only.columns, "left_semi")
        rest = [c for c in rows.columns if c not in (*key, "batch")]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        folder = f"{self.path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def members(self, below: int | None = None) -> DataFrame:
        """``chain, event_id, sec, position`` as of the last batch."""
        events = self.current("events", below).select("event_id", "sec")
        labels = self.current("labels", below).where("chain is not null")
        order = Window.partitionBy("chain").orderBy(F.asc_nulls_last("sec"), "event_id")
        return labels.join(events, "event_id").select("chain", "event_id", "sec", F.row_number().over(order).alias("position"))

    def edges(self, below: int | None = None) -> DataFrame:
        return self.current("edges", below).where("live").drop("live")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch`` of canonical events; an id that is stored already, or comes twice, is taken once."""
        self.spark = batch.sparkSession
        given = {f"given_{c}": F.col(c) if c in batch.columns else F.lit(None).cast("string") for c in _FOUND[:3]}
        batch = batch.drop("findings").withColumns(given)
        order = Window.partitionBy("event_id").orderBy(F.asc_nulls_last("sec"), *([F.asc("idx")] if "idx" in batch.columns else []))
        batch = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        stored = self.current("events", batch_id)
        if stored is not None:
            known = self._folders("events", batch_id).select("event_id")
            batch = batch.join(known, "event_id", "left_anti")
        changed = cut(self._findings(cut(batch), stored))
        changed = self._write(changed, "events", batch_id)
        edges = self._write(self._edges(changed, stored, batch_id), "edges", batch_id)
        self._write(self._labels(edges, batch_id), "labels", batch_id)

    def _findings(self, batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        """New events, and stored ones with other findings than before: the counting rules run anew over the keys that the batch has."""
        if stored is None:
            return enrich(batch, detect(batch, self.cfg))
        met = cut(counted_with(stored, batch))
        # Findings are told anew from what the events themselves say.
        plain = met.drop("findings").withColumns({c: F.col(f"given_{c}") for c in _FOUND[:3]})
        rows = plain.unionByName(batch, allowMissingColumns=True)
        told = enrich(rows, detect(rows, self.cfg))
        was = met.select("event_id", F.struct(*_FOUND).alias("was"))
        fresh = told.join(was, "event_id", "left")
        return fresh.where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.struct(*_FOUND))).drop("was")

    def _edges(self, changed: DataFrame, stored: DataFrame | None, batch_id: int) -> DataFrame:
        """Edges of the changed events with all others, and those they no longer have."""
        around = changed
        if stored is not None:
            others = stored.join(changed.select("event_id"), "event_id", "left_anti")
            around = changed.unionByName(partners(changed, others, self.cfg), allowMissingColumns=True)
        ids = changed.select(F.col("event_id").alias("id")).withColumn("hit", F.lit(True))
        a, b = (ids.withColumnsRenamed({"id": f"event_{s}", "hit": f"hit_{s}"}) for s in "ab")
        mine = lambda df: df.join(a, "event_a", "left").join(b, "event_b", "left").where("hit_a or hit_b").drop("hit_a", "hit_b")
        edges = mine(edges_of(score_pairs(candidates(cut(around), self.cfg), self.cfg), self.cfg)).withColumn("live", F.lit(True))
        before = self.current("edges", batch_id)
        if before is None:
            return edges
        edges = cut(edges)
        gone = mine(before.where("live")).join(edges.select("event_a", "event_b"), ["event_a", "event_b"], "left_anti")
        return edges.unionByName(gone.withColumn("live", F.lit(False)))

    def _labels(self, edges: DataFrame, batch_id: int) -> DataFrame:
        """Labels of the chains that the batch's edges touch, where they differ from before."""
        end = lambda df: df.select(F.explode(F.array("event_a", "event_b")).alias("event_id")).distinct()
        labels = self.current("labels", batch_id)
        before = self.current("edges", batch_id)
        touched = end(edges)
        if labels is None:
            found = components(self._strong(edges.where("live")))
            return found.select("event_id", F.col("component").alias("chain"))
        chains = labels.join(touched, "event_id", "left_semi").where("chain is not null").select("chain").distinct()
        was = cut(labels.join(chains, "chain", "left_semi").select("event_id", F.col("chain").alias("was")))
        reached = cut(was.select("event_id").union(touched).distinct())
        # Strong edges of a chain's event stay in its chain, so those of the reached events are all there are.
        kept = before.where("live").join(edges.select("event_a", "event_b"), ["event_a", "event_b"], "left_anti")
        inside = self._strong(kept).join(reached.withColumnRenamed("event_id", "event_a"), "event_a", "left_semi")
        found = components(inside.unionByName(self._strong(edges.where("live"))))
        both = reached.join(found, "event_id", "left").join(was, "event_id", "left")
        return both.where(~F.col("component").eqNullSafe(F.col("was"))).select("event_id", F.col("component").alias("chain"))

    def _strong(self, edges: DataFrame) -> DataFrame:
        """Edges that make chains: both ends carry a technique, or one does and the score is high."""
        seeded = (F.col("seed_a") & F.col("seed_b")) | ((F.col("seed_a") | F.col("seed_b")) & (F.col("total") >= self.cfg.absorb_score))
        return edges.where(seeded).select("event_a", "event_b")


def counted_with(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored events that the counting rules see together with a batch's: logons of its sources and accounts, connections of its sources."""
    source = F.lower(F.coalesce(filled(F.col("source_ip")), filled(F.col("host")), F.lit("unknown"))).alias("src")
    account = F.when(F.col("event_type") != "NETWORK_CONNECTION", F.lower(F.coalesce(filled(F.col("user")), F.lit("unknown")))).alias("acc")
    counted = F.col("event_type").isin("LOGIN_ATTEMPT", "LOGIN_SUCCESS", "NETWORK_CONNECTION")
    keys = batch.where(counted).select(source, F.coalesce(account, F.lit("")).alias("acc")).distinct()
    rows = stored.where(counted).withColumns({"src": source, "acc": F.coalesce(account, F.lit(""))})
    return rows.join(keys, ["src", "acc"], "left_semi").drop("src", "acc")


def partners(changed: DataFrame, others: DataFrame, cfg: Settings) -> DataFrame:
    """Stored events that can pair with changed ones: those that share a key, or stand near in time to an event without a host."""
    keys = changed.select(F.explode(entity_keys()).alias("key")).distinct()
    by_key = others.select("event_id", F.explode(entity_keys()).alias("key")).join(keys, "key", "left_semi").select("event_id")
    bucket = F.floor(F.col("sec") / cfg.broad_seconds)
    around = changed.where("sec is not null").select(F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"), filled(F.col("host")).isNull().alias("bare"))
    around = around.groupBy("bucket").agg(F.max("bare").alias("bare"))
    near = others.where("sec is not null").withColumn("bucket", bucket).join(around, "bucket").where(F.col("bare") | filled(F.col("host")).isNull())
    return others.join(by_key.union(near.select("event_id")).distinct(), "event_id", "left_semi")


def keep_chains(spark: SparkSession, path: str, cfg: Settings = DEFAULT) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a ``ChainStore`` under ``path`` that takes every batch."""
    return ChainStore(spark, path, cfg).add
