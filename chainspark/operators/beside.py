"""Pairs of one host at most ten minutes apart, scored by columns inside tasks; no pair is a row.

Spark deals the events by host and stretch of time and sorts them; an event near the begin of a stretch is also copied to
the one before.  A task slides over its rows and compares all with the one ``k`` rows later, for k = 1, 2, ... while
any is in reach.  It holds a block of rows and those still in reach of later ones.  Texts are compared by their
place in the block's dictionary, so scores are those of ``score_pairs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.config import Settings
from chainspark.dims import TACTICS
from chainspark.operators.blocking import ACTED, FIELDS, NEEDED, TAKERS

#: A stretch in widths of the window, and rows of a block.
STRETCH = 8
ROWS = 1 << 16
#: Events of one process name on a host up to which all their pairs are met in one task.
FAR_ROWS = 1 << 13
_TEXTS = tuple(f for f in FIELDS.values() if f != "host")


def _rows(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], more: dict[str, Column], far: bool = False) -> DataFrame:
    """What a task needs of each event (``rows`` with ``e`` and ``holds``), dealt by host and stretch and in order of time; with ``far`` by host and process name."""
    e, width = F.col("e"), cfg.broad_seconds * STRETCH
    kind = F.coalesce(*[F.when(e["event_type"] == t, i) for i, t in enumerate(NEEDED)])
    need = F.coalesce(*[F.when(e["event_type"] == t, e[f]) for t, f in NEEDED.items()])
    takes = sum((F.when(e["event_type"].isin(*TAKERS[f]), 1 << i).otherwise(0) for i, f in enumerate(NEEDED.values())), F.lit(0))
    acts = sum((F.when(e["event_type"].isin(*types), 1 << i).otherwise(0) for i, types in enumerate(ACTED)), F.lit(0))
    stretch = F.floor(e["sec"] / width)
    early = F.pmod(e["sec"], F.lit(width)) < cfg.broad_seconds
    places = F.when(early, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    untimed = e["sec"].isNull()
    if far:
        places, more = F.array(F.lit(0).cast("long")), {**more, "untimed": untimed}
    told = rows.where(e["host"].isNotNull() & (e["process_name"].isNotNull() if far else ~untimed)).select(
        *isolate_by, e["host"].alias("host"), F.coalesce(e["sec"], F.lit(1 << 62)).alias("sec"), e["event_id"].alias("event_id"), *[e[f].alias(f) for f in _TEXTS],
        e["process_name"].alias("process_name"), e["process_id"].cast("string").alias("own"), e["parent_process_id"].cast("string").alias("up"), e["made"].alias("made"), need.alias("need"),
        F.coalesce(kind, F.lit(0)).alias("kind"), takes.alias("takes"), acts.alias("acts"), F.coalesce(e["idx"], F.lit(-1)).cast("int").alias("idx"), e["seed"].alias("seed"), "holds",
        *[c.alias(n) for n, c in more.items()], F.posexplode(places).alias("copy", "stretch"),
    )
    by = [*isolate_by, "host", "process_name" if far else "stretch"]
    if far:
        told = told.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("n").between(2, FAR_ROWS)).drop("n")
        return told.sortWithinPartitions(*by, "sec", "event_id")
    return told.repartition(*by).sortWithinPartitions(*by, "sec", "event_id")


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Each column's values by their place in one dictionary of all, -1 for null."""
    plain = [c for column in columns for c in (column.chunks or [pa.array([], column.type)])]
    joined = pa.concat_arrays([c.cast(pa.large_string()) for c in plain]).dictionary_encode()
    places = joined.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    return np.split(places, np.cumsum([len(c) for c in columns])[:-1])


class Block:
    """Rows of a block as numbers; ``pairs`` slides over them."""

    def __init__(self, table: pa.Table, cfg: Settings, isolate_by: tuple[str, ...]):
        self.table, self.cfg, self.n = table, cfg, table.num_rows
        number = lambda c: table.column(c).to_numpy()
        self.sec, self.idx, self.seed, self.kind, self.takes, self.acts = (number(c) for c in ("sec", "idx", "seed", "kind", "takes", "acts"))
        self.first = number("copy") == 0
        self.far = "untimed" in table.column_names
        changed = np.zeros(self.n, bool)
        if self.far:
            self.untimed = number("untimed")
        for c in (*[_codes(table.column(c))[0] for c in (*isolate_by, "host", *["process_name"] * self.far)], number("stretch")):
            changed[1:] |= c[1:] != c[:-1]
        self.group = np.cumsum(changed, dtype=np.int32)
        self.texts = {f: _codes(table.column(f))[0] for f in _TEXTS}
        self.own, self.up = _codes(table.column("own"), table.column("up"))
        lists = table.column("holds").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        self.holder = np.repeat(np.arange(self.n), sizes)
        names = ("process_name", "made", "need")
        self.process, self.made, self.need, self.held = _codes(*[table.column(c) for c in names], pa.chunked_array([lists.flatten()], lists.type.value_type))
        self.capped = "cut" in table.column_names
        if self.capped:
            # Ids and cuts by their place in the order of both.
            ids = pa.chunked_array([*table.column("event_id").chunks, *table.column("cut").chunks]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(ids.dictionary).to_numpy()
            rank = np.empty(len(order) + 1, np.int64)
            rank[order], rank[-1] = np.arange(len(order)), len(order)
            self.place, self.cut = np.split(rank[ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)], 2)
        w = cfg.weights
        tenth = lambda weight, tenths: int(weight * tenths / 10)
        gaps = np.arange(cfg.broad_seconds + 1)
        shares = np.where(gaps <= cfg.strict_seconds, 10, np.where(gaps <= cfg.normal_seconds, 8, 5))
        self.by_gap = np.array([tenth(w["temporal"], s) for s in range(11)], np.int32)[shares]
        steps = range(-1, len(TACTICS))
        flow = lambda a, b: 0 if a < 0 or b < 0 else 3 if b < a else 10 if b - a <= 6 else 6
        self.flow = np.array([[tenth(w["attack_progression"], flow(a, b)) for b in steps] for a in steps], np.int32)

    def done(self) -> int:
        """How many rows have all rows in reach in this block, whatever comes after it."""
        start = np.searchsorted(self.group, self.group[-1])
        if self.far:
            return int(start)
        return int(start + np.searchsorted(self.sec[start:], self.sec[-1] - self.cfg.broad_seconds))

    def pairs(self, until: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray], np.ndarray]]:
        """``k``, for the pairs of a row and the one ``k`` later whether they are an edge, their points by signal and in all; rows before ``until`` as the first."""
        cfg, w = self.cfg, self.cfg.weights
        for k in range(1, self.n):
            m = min(until, self.n - k)
            if m <= 0:
                return
            a, b = slice(0, m), slice(k, k + m)
            gap = self.sec[b] - self.sec[a]
            reach = self.first[a] & (self.group[a] == self.group[b])
            if not self.far:
                reach &= gap <= cfg.broad_seconds
            if not reach.any():
                return
            if self.far:
                reach &= (gap > cfg.broad_seconds) | self.untimed[b]
            if self.capped:
                reach = reach & ((self.place[b] <= self.cut[a]) | (self.place[a] <= self.cut[b]))
            same = lambda x, y=None: (x[a] == (x if y is None else y)[b]) & (x[a] >= 0)  # noqa: B023, E731
            eq = {signal: same(self.texts[f]) for signal, f in FIELDS.items() if f != "host"}
            gives, taken = same(self.made, self.process), same(self.process, self.made)
            needs = np.zeros(m, bool)
            # Needles that the later event's command holds, then those that the earlier one's holds.
            low, high = np.searchsorted(self.holder, (k, k + m))
            at, value = self.holder[low:high] - k, self.held[low:high]
            gives[at[self.made[at] == value]] = True
            needs[at[(self.need[at] == value) & (self.takes[at + k] >> self.kind[at] & 1 > 0)]] = True
            high = np.searchsorted(self.holder, m)
            at, value = self.holder[:high], self.held[:high]
            taken[at[self.made[at + k] == value]] = True
            process = same(self.own, self.up) | same(self.up, self.own) | same(self.process) | gives | taken
            depends = gives | ((self.acts[a] & 1 > 0) & (self.acts[b] & 2 > 0) & eq["same_user"]) | needs
            points = {s: v * np.int32(w[s]) for s, v in {**eq, "process_relationship": process, "event_dependency": depends}.items()}
            points["temporal"] = np.zeros(m, np.int32) if self.far else self.by_gap[np.clip(gap, 0, cfg.broad_seconds)]
            points["same_host"] = np.full(m, w["same_host"], np.int32)
            points["attack_progression"] = self.flow[self.idx[a] + 1, self.idx[b] + 1]
            total = sum(points.values())
            yield k, reach & (total >= cfg.min_edge_score) & (total > points["temporal"] + points["same_host"]), points, total


def _folded(cfg: Settings, isolate_by: tuple[str, ...], fold: Callable[[Block, int], Iterator[pa.Table]]):
    """A function of batches that gives ``fold(block, until)`` of every block."""
    least = ROWS

    def run(batches):
        held, n, enough = [], 0, least
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n < enough:
                continue
            block = Block(pa.Table.from_batches(held), cfg, isolate_by)
            until = block.done()
            for out in fold(block, until):
                yield from out.to_batches()
            rest = block.table.slice(until)
            held, n = rest.to_batches(), rest.num_rows
            # Rows that stay in reach are read again, so the next block holds at least as many new ones.
            enough = least + 2 * n
        if n:
            for out in fold(Block(pa.Table.from_batches(held), cfg, isolate_by), n):
                yield from out.to_batches()

    return run


def smallest_rows(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component over pairs ``x, y``."""
    label = np.arange(n)
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def parts(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], strong: bool) -> DataFrame:
    """``num, root``: events (by their ``num``) that have an edge here, with one of those that edges within a block connect to it."""

    def fold(block: Block, until: int):
        found = [np.empty((2, 0), np.int64)]
        for k, edge, _, total in block.pairs(until):
            if strong:
                m = len(edge)
                one, other = block.seed[:m], block.seed[k : k + m]
                edge = edge & (one & other | (one | other) & (total >= cfg.absorb_score))
            at = np.nonzero(edge)[0]
            found.append(np.stack([at, at + k]))
        x, y = np.concatenate(found, axis=1)
        label, num = smallest_rows(block.n, x, y), block.table.column("num").to_numpy()
        met = np.zeros(block.n, bool)
        met[x] = met[y] = True
        yield pa.table({"num": num[met], "root": num[label[met]]})

    return _rows(rows, cfg, isolate_by, {"num": F.col("num")}).mapInArrow(_folded(cfg, isolate_by, fold), "num long, root long")


def tallies(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """``isolate_by, event_a, links, best``, each group's summed points and ``best_<group>`` over the edges of each earlier event."""

    def fold(block: Block, until: int):
        links = np.zeros(block.n, np.int64)
        best = {g: np.zeros(block.n, np.int32) for g in ("", *groups)}
        none = np.iinfo(np.int32).min
        for values in best.values():
            values[:] = none
        sums = {g: np.zeros(block.n, np.int64) for g in groups}
        for _, edge, points, total in block.pairs(until):
            m = len(edge)
            links[:m] += edge
            scored = np.where(edge, total, none)
            np.maximum(best[""][:m], scored, out=best[""][:m])
            for g, signals in groups.items():
                own = sum(points[s] for s in signals) * edge
                sums[g][:m] += own
                np.maximum(best[g][:m], np.where(own > 0, scored, none), out=best[g][:m])
        at = np.nonzero(links)[0]
        shown = lambda g: pa.array(best[g][at], mask=best[g][at] == none)
        own = {c: block.table.column(c).take(at) for c in (*isolate_by, "event_id")}
        yield pa.table([*own.values(), pa.array(links[at]), shown(""), *[pa.array(sums[g][at]) for g in groups], *[shown(g) for g in groups]], [*isolate_by, "event_a", "links", "best", *groups, *[f"best_{g}" for g in groups]])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*isolate_by, F.col("e.event_id").alias("event_a")).schema)
    ddl = ", ".join([given, "links long, best int", *[f"`{g}` long" for g in groups], *[f"best_{g} int" for g in groups]])
    return _rows(rows, cfg, isolate_by, {}).mapInArrow(_folded(cfg, isolate_by, fold), ddl)


def kinds(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], signals: tuple[str, ...]) -> DataFrame:
    """``window``, points of each signal and ``n``: how many edges there are of each kind, a few rows a block."""
    names = np.array(["STRICT", "NORMAL", "BROAD"])
    either = [s for s in signals if s not in ("temporal", "same_host", "attack_progression")]

    def fold(block: Block, until: int):
        flows = np.unique(block.flow)
        size = 3 * len(flows) << len(either)
        found = np.zeros(size, np.int64)
        for k, edge, points, _ in block.pairs(until):
            at = np.nonzero(edge)[0]
            gap = block.sec[at + k] - block.sec[at]
            code = np.where(gap <= cfg.strict_seconds, 0, np.where(gap <= cfg.normal_seconds, 1, 2))
            code = code * len(flows) + np.searchsorted(flows, points["attack_progression"][at])
            for s in either:
                code = code * 2 + (points[s][at] != 0)
            found += np.bincount(code, minlength=size)
        code = np.nonzero(found)[0]
        left, out = code, {}
        for s in reversed(either):
            left, bit = np.divmod(left, 2)
            out[s] = bit * cfg.weights[s]
        window, flow = np.divmod(left, len(flows))
        lasting = np.array([cfg.strict_seconds, cfg.normal_seconds, cfg.broad_seconds])[window]
        out |= {"temporal": block.by_gap[lasting], "same_host": np.full(len(code), cfg.weights["same_host"]), "attack_progression": flows[flow]}
        yield pa.table([pa.array(names[window]), *[pa.array(out[s].astype(np.int32)) for s in signals], pa.array(found[code])], ["window", *signals, "n"])

    ddl = ", ".join(["window string", *[f"{s} int" for s in signals], "n long"])
    return _rows(rows, cfg, isolate_by, {}).mapInArrow(_folded(cfg, isolate_by, fold), ddl)


def edges(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], signals: tuple[str, ...], capped: bool = False, far: bool = False) -> DataFrame:
    """``event_a, event_b, window, total`` and points of ``signals`` of every edge; ``capped`` leaves out pairs that are beyond the ``cut`` of both events.

    With ``far``, those of one process name on a host that lie further apart or have no time, where it has at most ``FAR_ROWS`` events.
    """

    def fold(block: Block, until: int):
        ids = block.table.column("event_id").combine_chunks()
        for k, edge, points, total in block.pairs(until):
            at = np.nonzero(edge)[0]
            if len(at):
                gap = block.sec[at + k] - block.sec[at]
                window = pa.nulls(len(at), pa.string()) if far else pa.array(np.where(gap <= cfg.strict_seconds, "STRICT", np.where(gap <= cfg.normal_seconds, "NORMAL", "BROAD")), pa.string())
                yield pa.table([ids.take(pa.array(at)), ids.take(pa.array(at + k)), window, pa.array(total[at]), *[pa.array(points[s][at]) for s in signals]], ["event_a", "event_b", "window", "total", *signals])

    ddl = ", ".join(["event_a string, event_b string, window string, total int", *[f"{s} int" for s in signals]])
    more = {"cut": F.col("cut")} if capped else {}
    return _rows(rows, cfg, isolate_by, more, far).mapInArrow(_folded(cfg, isolate_by, fold), ddl)
