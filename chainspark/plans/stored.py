"""Derived tables of the driver's events, each built once a session and then read by every query that needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.operators import chains as C
from chainspark.operators import rules
from chainspark.sinks.store import Store, spread
from chainspark.sources.telemetry import telemetry


class Derived:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.store = Store(spark, f"{sf_dir}/events.parquet")

    @property
    def telemetry(self) -> DataFrame:
        return self.store.table("telemetry", lambda: spread(telemetry(self.spark, self.sf_dir)))

    @property
    def detections(self) -> DataFrame:
        return self.store.table("detections", lambda: rules.detect(self.telemetry))

    @property
    def events(self) -> DataFrame:
        return self.store.table("events", lambda: rules.enrich(self.telemetry, self.detections))

    @property
    def edges(self) -> DataFrame:
        return self.store.table("edges", lambda: C.every_edge(self.events, rows=self.prepared))

    @property
    def each_edge(self) -> DataFrame:
        """``edges`` for a query that reads them once: as stored, if they are, else made as they are read."""
        return self.edges if self.store.has("edges") else C.every_edge(self.events, rows=self.prepared)

    def prepared(self) -> DataFrame:
        """Events as the counted forms of clusters, members and tally read them; made only where events are many."""
        return self.store.table("prepared", lambda: C.prepared(self.events))

    @property
    def clusters(self) -> DataFrame:
        return self.store.table("clusters", lambda: C.clusters(self.events, rows=self.prepared))

    @property
    def members(self) -> DataFrame:
        return self.store.table("members", lambda: C.linked_members(self.events, rows=self.prepared))

    @property
    def kinds(self) -> DataFrame:
        """How many edges there are of each kind; no edge is stored for it."""
        return self.store.table("kinds", lambda: C.edge_kinds(self.events, rows=self.prepared))

    @property
    def internal(self) -> DataFrame:
        """Edges inside chains, joined to both ends once; its users only combine it by chain."""
        return self.store.table("internal", lambda: C.internal_edges(self.edges, self.members))

    @property
    def tally(self) -> DataFrame:
        """What the edges inside chains come to, an event a row."""
        return self.store.table("tally", lambda: C.tally(self.events, self.members, rows=self.prepared))

    @property
    def confidence(self) -> DataFrame:
        return self.store.table("confidence", lambda: C.confidence_of(self.tally))

    @property
    def chains(self) -> DataFrame:
        make = lambda: C.numbered(C.verdicts(C.roll_up(self.members, self.events, self.detections), self.confidence))
        return self.store.table("chains", make)

    @property
    def steps(self) -> DataFrame:
        return self.store.table("steps", lambda: C.missing_steps(self.chains, self.members, self.events))

    @property
    def evidence(self) -> DataFrame:
        return self.store.table("evidence", lambda: C.evidence(self.members, self.events, self.detections, C.strongest_links(self.tally, self.events, self.members, 6), self.steps))

    @property
    def graph(self) -> DataFrame:
        from chainspark.operators import graph

        return self.store.table("graph", lambda: graph.graph_edges(self.members, self.events, self.detections))

    @property
    def feedback(self) -> DataFrame:
        """A log of analysts' entries, one of a few kinds a chain by its first activity; every ninth is of no known status."""
        n = F.col("start_sec") % 9
        status = F.when(n == 8, "maybe").when(n % 3 == 0, "confirmed").when(n % 3 == 1, " Closed ").otherwise("INVESTIGATING")
        first = self.chains.select("chain", F.col("start_sec").alias("at"), status.alias("status"), F.lit("first look").alias("comment"))
        later = self.chains.where(n < 4).select("chain", (F.col("start_sec") + 60).alias("at"), F.lit("FALSE_POSITIVE").alias("status"), F.lit("second look").alias("comment"))
        return first.unionByName(later)


def derived(spark: SparkSession, sf_dir: str) -> Derived:
    return Derived(spark, sf_dir)
