"""The counting rules over streams, with state a key in RocksDB: repeated failures, a success after them, and fan-out.

Rows of a batch are taken in order of time and id.  What a key has seen before can be given as
initial state, from stored events.  A key without rows for ``forget_after`` seconds of event time is
forgotten by a timer.  Rows that come later than ones already counted are counted as they come; a
``ChainStore`` tells such keys anew from their stored events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from chainspark.config import DEFAULT, Settings
from chainspark.functions.scalars import filled, is_private_ip

FINDING = "event_id string, rule_id string, severity string, technique_id string, count int"
#: The provider that keeps list and map state; set it before a query with these rules starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST = 50
_LONG = StructType([StructField("value", LongType())])
_INT = StructType([StructField("value", IntegerType())])
_TEXT = StructType([StructField("value", StringType())])
_KEPT = "kind string, at long, item string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Counting(StatefulProcessor):
    """Shared: ordered rows, a timer that forgets, and the running number of time."""

    def __init__(self, forget_after: int):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordered = pd.concat(list(rows)).sort_values(["sec", "event_id"])
        found = self.count(ordered)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(max(ordered["sec"].max(), 0) + self.forget_after) * 1000)
        yield pd.DataFrame(found, columns=["event_id", "rule_id", "severity", "technique_id", "count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class Logons(_Counting):
    """Failure times since the last success (fifty at most, as list state) and the count at the last failure."""

    def __init__(self, cfg: Settings, forget_after: int):
        super().__init__(forget_after)
        self.window, self.enough = cfg.brute_force_window, cfg.brute_force_failures

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.times, self.last = handle.getListState("times", _LONG), handle.getValueState("last", _INT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("at")
        self.times.put([(int(t),) for t in rows["at"][rows["kind"] == "failure"]][-MOST:])
        last = rows["at"][rows["kind"] == "last"]
        if len(last):
            self.last.update((int(last.iloc[0]),))

    def count(self, rows: pd.DataFrame) -> list[tuple]:
        times = [t for (t,) in self.times.get()] if self.times.exists() else []
        last = self.last.get()[0] if self.last.exists() else 0
        found = []
        for r in rows.itertuples():
            if r.kind == "LOGIN_ATTEMPT":
                times = [*(t for t in times if t >= r.sec - self.window), int(r.sec)]
                last = min(len(times), MOST + 1)
                if last >= self.enough:
                    found.append((r.event_id, "AUTH_BRUTE_FORCE", "HIGH", "T1110.001", last))
                times = times[-MOST:]
            else:
                if last >= self.enough:
                    found.append((r.event_id, "AUTH_SUCCESS_AFTER_FAILURES", "CRITICAL", "T1078", min(last, MOST)))
                times, last = [], 0
        self.times.put([(t,) for t in times]) if times else self.times.clear()
        self.last.update((last,))
        return found

    def forget(self) -> None:
        self.times.clear()
        self.last.clear()


class Destinations(_Counting):
    """The external addresses a source has reached, as map state, and how many they are."""

    def __init__(self, cfg: Settings, forget_after: int):
        super().__init__(forget_after)
        self.enough = cfg.scan_destinations

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen, self.number = handle.getMapState("seen", _TEXT, _LONG), handle.getValueState("number", _LONG)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.seen.updateValue((r.item,), (int(r.at),))
        self.number.update((len(initialState),))

    def count(self, rows: pd.DataFrame) -> list[tuple]:
        number = self.number.get()[0] if self.number.exists() else 0
        found = []
        for r in rows.itertuples():
            if not self.seen.containsKey((r.item,)):
                self.seen.updateValue((r.item,), (int(r.sec),))
                number += 1
            if number >= self.enough:
                found.append((r.event_id, "MULTIPLE_REMOTE_PORTS", "MEDIUM", "T1046", number))
        self.number.update((number,))
        return found

    def forget(self) -> None:
        self.seen.clear()
        self.number.clear()


def _source():
    return F.lower(F.coalesce(filled(F.col("source_ip")), filled(F.col("host")), F.lit("unknown"))).alias("source")


def _logons(events: DataFrame) -> DataFrame:
    account = F.lower(F.coalesce(filled(F.col("user")), F.lit("unknown"))).alias("account")
    return events.where(F.col("event_type").isin("LOGIN_ATTEMPT", "LOGIN_SUCCESS") & F.col("sec").isNotNull()).select("event_id", "sec", "timestamp", F.col("event_type").alias("kind"), _source(), account)


def _outside(events: DataFrame) -> DataFrame:
    target = F.coalesce(F.col("destination_ip"), F.lit(""))
    rows = events.where((F.col("event_type") == "NETWORK_CONNECTION") & (target != "") & ~is_private_ip(target) & F.col("sec").isNotNull())
    return rows.select("event_id", "sec", "timestamp", target.alias("item"), _source())


def stream_logons(events: DataFrame, cfg: Settings = DEFAULT, late: str = "10 minutes", forget_after: int = 86_400, stored: DataFrame | None = None) -> DataFrame:
    """Repeated failures of a source and account, and a success that follows them; ``stored`` events have been before the stream."""
    rows = _logons(events).withWatermark("timestamp", late)
    before = None if stored is None else logons_before(stored, cfg).groupBy("source", "account")
    return rows.groupBy("source", "account").transformWithStateInPandas(Logons(cfg, forget_after), FINDING, "Append", "EventTime", before)


def stream_fan_out(events: DataFrame, cfg: Settings = DEFAULT, late: str = "10 minutes", forget_after: int = 86_400, stored: DataFrame | None = None) -> DataFrame:
    """Sources that have reached eight or more distinct external addresses so far; ``stored`` events have been before the stream."""
    rows = _outside(events).withWatermark("timestamp", late)
    before = None if stored is None else _outside(stored).groupBy("source", "item").agg(F.min("sec").alias("at")).select("source", F.lit("seen").alias("kind"), "at", "item").groupBy("source")
    return rows.groupBy("source").transformWithStateInPandas(Destinations(cfg, forget_after), FINDING, "Append", "EventTime", before)


def logons_before(stored: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """State of each key after stored events: ``source, account, kind, at, item``, its failure times since the last success and their count."""
    rows = _logons(stored)
    when = F.struct("sec", "event_id")
    key = ["source", "account"]
    done = rows.where("kind = 'LOGIN_SUCCESS'").groupBy(*key).agg(F.max(when).alias("done"))
    failed = rows.where("kind = 'LOGIN_ATTEMPT'").join(done, key, "left").where(F.col("done").isNull() | (when > F.col("done")))
    # A key's failures count only within the window before its last one.
    last = failed.groupBy(*key).agg(F.max("sec").alias("last"))
    kept = failed.join(last, key).where(F.col("sec") >= F.col("last") - cfg.brute_force_window)
    n = kept.groupBy(*key).agg(F.least(F.count(F.lit(1)), F.lit(MOST + 1)).alias("at")).select(*key, F.lit("last").alias("kind"), "at", F.lit("").alias("item"))
    return kept.select(*key, F.lit("failure").alias("kind"), F.col("sec").alias("at"), F.lit("").alias("item")).unionByName(n)
