"""Chains linked and tallied without making every pair of a process.

Pairs of one host within ten minutes are scored inside tasks (``beside``); those of an event without a host and those
of two hosts that share a key are made by buckets of time.  Further apart, a pair counts by what it has besides host and process name, and only
fields whose value lies over ten minutes apart can add to that; pairs that have nothing else are counted by windows
(``plain``), as all of one process name and one step of tactics score alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.config import Settings
from chainspark.dims import TACTICS
from chainspark.operators import beside
from chainspark.operators.blocking import FIELDS, LINK_PAIRS, _meet, far_keys, far_sets, link_sets, minimal, stars, told
from chainspark.operators.components import components
from chainspark.operators.correlate import GROUPS, SIGNALS, edges_of, is_strong, score_pairs
from chainspark.sinks.store import kept

#: Fields of which a value held at one time only adds nothing to pairs further apart.
SHARED = tuple(f for f in FIELDS.values() if f != "host")
PLAIN = frozenset({"host", "same_process"})
#: Rows for each event a key may have, beyond which keys are not counted first.
MANY = 1024


def _earlier() -> Column:
    """Whether ``a`` comes before ``b`` by (time nulls last, id)."""
    x, y = (F.coalesce(F.col(f"{s}.sec"), F.lit(1 << 62)) for s in "ab")
    return (x < y) | ((x == y) & (F.col("a.event_id") < F.col("b.event_id")))


def _sides(rows: DataFrame, other: DataFrame, by: list[str], when: Column, isolate_by: tuple[str, ...]) -> DataFrame:
    """Pairs ``a`` of ``rows`` and ``b`` of ``other`` of one bucket and equal ``by``."""
    on = ["bucket", *by, *isolate_by]
    side = lambda df, x: df.select(F.col("e").alias(x), *on, *[F.col(c).alias(f"{c}_{x}") for c in ("keys",) if c in df.columns])
    return side(rows, "a").join(side(other, "b"), on).where(when).select("a", "b", *isolate_by)


def _timed(keyed: DataFrame, cfg: Settings) -> DataFrame:
    return keyed.where("e.sec is not null").withColumn("bucket", F.floor(F.col("e.sec") / cfg.broad_seconds))


def _in_reach(cfg: Settings) -> Column:
    """Whether ``a`` comes before ``b`` and at most ten minutes."""
    forward = (F.col("a.sec") < F.col("b.sec")) | ((F.col("a.sec") == F.col("b.sec")) & (F.col("a.event_id") < F.col("b.event_id")))
    return forward & (F.col("b.sec") - F.col("a.sec") <= cfg.broad_seconds)


def near(keyed: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = (), when: Column | None = None) -> DataFrame:
    """Pairs at most ten minutes apart that can become edges, each once; ``when`` narrows them by ``a`` and ``b``."""
    # The earlier event looks into its own bucket and the next one.
    hosted = _timed(keyed, cfg).where("e.host is not null").select("e", *isolate_by, "bucket", F.xxhash64("e.host").alias("at"))
    ahead = hosted.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    wanted = F.lit(True) if when is None else when
    same = _sides(ahead, hosted, ["at"], _in_reach(cfg) & (F.col("a.host") == F.col("b.host")) & wanted, isolate_by)
    return same.unionByName(elsewhere(keyed, cfg, isolate_by, when))


def elsewhere(keyed: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = (), when: Column | None = None) -> DataFrame:
    """Those pairs of ``near`` that are not of one host."""
    width, timed = cfg.broad_seconds, _timed(keyed, cfg)
    gap = F.col("b.sec") - F.col("a.sec")
    wanted = F.lit(True) if when is None else when
    own = ["e", *isolate_by]
    # The one without a host looks to both sides and the pair is put in order; of two without, the one that comes first looks.
    around = F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1))
    bare = timed.where("e.host is null").select(*own, "bucket").withColumn("bucket", around)
    once = (F.abs(gap) <= width) & (F.col("a.event_id") != F.col("b.event_id")) & (_in_reach(cfg) | F.col("b.host").isNotNull()) & wanted
    single = _sides(bare, timed.select(*own, "bucket"), [], once, isolate_by)
    single = single.select(*[F.when(_earlier(), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in ("ab", "ba")], *isolate_by)
    # Two hosts share a key only of those that are held on several.
    fields = F.array_compact(F.array(*[F.when(F.col("e")[f].isNotNull(), F.xxhash64(F.lit(f), F.col("e")[f])) for f in SHARED]))
    each = timed.where("e.host is not null").select("e.host", fields.alias("keys"), *isolate_by)
    across = each.select("host", F.explode("keys").alias("key"), *isolate_by).groupBy("key", *isolate_by).agg(F.min("host").alias("first"), F.max("host").alias("last")).where("first <> last").drop("first", "last")
    held = timed.where("e.host is not null").select(*own, "bucket", fields.alias("keys")).withColumn("key", F.explode("keys")).join(across, ["key", *isolate_by])
    smallest = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    ahead = held.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    crossed = _sides(ahead, held, ["key"], _in_reach(cfg) & (F.col("a.host") != F.col("b.host")) & wanted & smallest, isolate_by)
    return single.unionByName(crossed)


def widely_held(keyed: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = ()) -> DataFrame:
    """``keyed`` with ``wide``: the event's fields without values that no two events over ten minutes apart (or without a time) share."""
    e = F.col("e")
    pairs = F.array_compact(F.array(*[F.when(e[f].isNotNull(), F.struct(F.lit(f).alias("field"), e[f].alias("value"))) for f in SHARED]))
    each = keyed.select(e["event_id"].alias("id"), e["sec"].alias("sec"), F.inline(pairs), *isolate_by)
    on = ["field", "value", *isolate_by]
    spans = each.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count("sec").alias("timed"), F.min("sec").alias("first"), F.max("sec").alias("last"))
    wide = spans.where((F.col("n") > 1) & ((F.col("timed") < F.col("n")) | (F.col("last") - F.col("first") > cfg.broad_seconds))).select(*on)
    own = each.join(wide, on).groupBy("id", *isolate_by).agg(F.collect_set("field").alias("fields"))
    met = keyed.withColumn("id", e["event_id"]).join(own, ["id", *isolate_by], "left")
    fields = [F.when(F.array_contains("fields", f), e[f]).alias(f) for f in SHARED]
    return met.withColumn("wide", F.struct(e["host"].alias("host"), *fields)).drop("id", "fields")


def possible(sets: list, rows: DataFrame) -> list:
    """Those of ``sets`` (or of pairs that begin with a set) whose evidence occurs at all; one row of flags is read."""
    e = F.col("e")
    seen = {f: F.col("wide")[f].isNotNull() for f in SHARED}
    seen |= {"host": e["host"].isNotNull(), "same_process": e["process_name"].isNotNull(), "refers": e["made"].isNotNull(), "needs": F.size("holds") > 0, "hostless": e["host"].isNull(), "loose": e["host"].isNull()}
    seen |= {"lineage": e["process_id"].isNotNull(), "tactics": e["idx"].isNotNull(), "seeds": e["seed"], "one_seed": e["seed"]}
    found = rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in seen.items()]).first()
    lacking = {k for k in seen if not found[k]}
    return [s for s in sets if not lacking & (s if isinstance(s, frozenset) else s[0])]


def far(rows: DataFrame, sets: list[frozenset[str]], cfg: Settings, isolate_by: tuple[str, ...] = (), when: Column | None = None) -> DataFrame:
    """Pairs over ten minutes apart (or without a time) that have all of one of ``sets``; ``rows`` with ``keys``, ``holds`` and ``wide``."""
    rows, sets = rows.withColumn("hot", F.col("keys")), possible(sets, rows)
    first, second = far_keys(sets, F.col("wide"))
    side = lambda c: rows.select("e", c.alias("keys"), *isolate_by)
    gap = F.abs(F.col("a.sec") - F.col("b.sec"))
    wanted = F.lit(True) if when is None else when
    return _meet(side(first), side(second), isolate_by, wanted & _earlier() & F.coalesce(gap > cfg.broad_seconds, F.lit(True)))


def special_sets(cfg: Settings) -> list[frozenset[str]]:
    """Sets of evidence of which a pair further apart has one if it can be an edge by more than host, process name and tactics, or scores more than by those alone."""
    more = [PLAIN | {x} for x in (*SHARED, "lineage", "refers", "needs")]
    return minimal([s for s in far_sets(cfg) if not s <= PLAIN | {"tactics"}] + more)


def countable(cfg: Settings) -> bool:
    """Whether pairs of a host alone make no edge further apart, so that pairs of one process can be counted for all plain ones."""
    return cfg.weights["same_host"] + cfg.weights["attack_progression"] < cfg.min_edge_score


def flow_points(first: Column, second: Column, cfg: Settings) -> Column:
    tenths = F.when(first.isNull() | second.isNull(), 0).when(second < first, 3).when(second - first <= 6, 10).otherwise(6)
    return (F.lit(cfg.weights["attack_progression"]) * tenths / 10).cast("int")


def plain(keyed: DataFrame, cfg: Settings, isolate_by: tuple[str, ...]) -> DataFrame:
    """``event_a, n, flow`` and ``isolate_by``: later events over ten minutes away (or without a time) of one host and process name, by points of tactics."""
    rows = keyed.where("e.host is not null and e.process_name is not null").select(
        *isolate_by, "e.host", "e.process_name", "e.sec", "e.event_id", "e.idx", F.col("e.sec").isNull().alias("untimed"), F.coalesce(-F.col("e.sec"), F.lit(-(1 << 62))).alias("back")
    )
    by = [*isolate_by, "host", "process_name"]
    later = Window.partitionBy(*by).orderBy("back").rangeBetween(Window.unboundedPreceding, -cfg.broad_seconds - 1)
    after = Window.partitionBy(*by, "untimed").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    steps = [None, *range(len(TACTICS))]
    this = lambda i: F.col("idx").isNull() if i is None else F.col("idx") == i
    told = rows.select(*isolate_by, "event_id", "idx", "untimed", *[F.count_if(this(i)).over(later).alias(f"t{j}") for j, i in enumerate(steps)], *[F.count_if(this(i)).over(after).alias(f"u{j}") for j, i in enumerate(steps)])
    counted = [F.struct(F.when(F.col("untimed"), F.col(f"u{j}")).otherwise(F.col(f"t{j}")).alias("n"), flow_points(F.col("idx"), F.lit(i).cast("int"), cfg).alias("flow")) for j, i in enumerate(steps)]
    return told.select(*isolate_by, F.col("event_id").alias("event_a"), F.inline(F.array(*counted))).where("n > 0")


def is_busy(keyed: DataFrame, isolate_by: tuple[str, ...] = (), most: int = LINK_PAIRS, of: DataFrame | None = None) -> bool:
    """Whether a key may have more than ``most`` events, so that all its pairs are many; ``of`` has as many rows, to be counted first."""
    if (keyed if of is None else of).count() > most * MANY:
        return True
    counts = keyed.select(F.explode("keys").alias("key"), *isolate_by).groupBy("key", *isolate_by).agg(F.count(F.lit(1)).alias("n"))
    return not counts.where(F.col("n") > most).isEmpty()


def prepared(keyed: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = ()) -> DataFrame:
    """What ``connected``, ``tallied`` and ``kinds`` read of events, to be stored: ``keyed`` with ``holds``, ``wide`` and a number ``num``."""
    return widely_held(told(keyed), cfg, isolate_by).withColumn("num", F.monotonically_increasing_id())


def connected(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...], strong: bool) -> DataFrame:
    """``event_id, component`` of all edges, or of all that join chains; ``rows`` as ``prepared`` and stored.

    What edges within ten minutes on a host connect is one part from the begin.  Parts are joined where they share a set of
    evidence that makes an edge of any two events; then only pairs of different parts are left to be scored.
    """
    found = lambda pairs: edges_of(score_pairs(pairs, cfg, ("a", "b")), cfg).where(is_strong(cfg) if strong else F.lit(True))
    open_sets, sure, seeds = link_sets(cfg, strong)
    close = kept(beside.parts(rows, cfg, isolate_by, strong))
    own = close.groupBy("num").agg(F.min("root").alias("part"))
    # An event of two blocks joins what it belongs to in each.
    bridges = close.join(own, "num").where("root <> part").select(F.col("root").alias("event_a"), F.col("part").alias("event_b")).distinct()
    placed = kept(rows.join(own, "num", "left").withColumn("met", F.col("part").isNotNull()).withColumn("part", F.coalesce("part", "num")))
    of = F.col("part")
    links = bridges.unionByName(stars(placed, possible(sure, rows), isolate_by, F.col("wide"), of))
    if seeds:
        links = links.unionByName(stars(placed.where("e.seed"), possible(seeds, rows), isolate_by, F.col("wide"), of))
    first = components(links).select(F.col("event_id").alias("part"), F.col("component").alias("whole"))
    whole = F.coalesce("whole", "part")
    placed = placed.join(first, "part", "left").withColumn("met", F.col("met") | F.col("whole").isNotNull())
    placed = kept(placed.withColumn("e", F.col("e").withField("part", whole)).drop("part", "whole"))
    apart = F.col("a.part") != F.col("b.part")
    apart = apart & (F.col("a.seed") | F.col("b.seed")) if strong else apart
    # Of a host of one part no pair is left.
    here = F.col("e.host").alias("here")
    open_hosts = placed.groupBy(here, *isolate_by).agg(F.min("e.part").alias("low"), F.max("e.part").alias("high")).where("low <> high").drop("low", "high")
    some = placed.withColumn("here", here).join(open_hosts, ["here", *isolate_by], "left_semi").drop("here")
    hosted, others = [s for s in open_sets if "host" in s], [s for s in open_sets if "host" not in s]
    rest = elsewhere(placed, cfg, isolate_by, apart).unionByName(far(some, hosted, cfg, isolate_by, apart)).unionByName(far(placed, others, cfg, isolate_by, apart))
    joined = components(found(rest).select(F.col("a.part").alias("event_a"), F.col("b.part").alias("event_b")).distinct())
    over = joined.select(F.col("event_id").alias("part"), F.col("component").alias("whole"))
    settled = placed.select("e.event_id", "e.part", "met").join(over, "part", "left").where("met or whole is not null").select("event_id", whole.alias("of"))
    settled = kept(settled)
    # Parts are numbers up to here; a component is named by its smallest event id.
    names = settled.groupBy("of").agg(F.min("event_id").alias("component"))
    return settled.join(names, "of").select("event_id", "component")


def _special(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...]) -> DataFrame:
    """Scores of the pairs further apart that have more than host and process name, and whether and how they count as plain ones too."""
    also = F.coalesce((F.col("a.host") == F.col("b.host")) & (F.col("a.process_name") == F.col("b.process_name")), F.lit(False))
    scored = score_pairs(far(rows, special_sets(cfg), cfg, isolate_by), cfg, (*isolate_by, "a", "b"))
    return scored.select(*isolate_by, "event_a", "event_b", "total", "window", *SIGNALS, also.alias("also_plain"), flow_points(F.col("a.idx"), F.col("b.idx"), cfg).alias("flow"))


def _plain_score(cfg: Settings) -> tuple[dict[str, Column], Column, Column]:
    """Points of a plain pair by its ``flow``, their sum, and whether it is an edge."""
    base = {"same_host": F.lit(cfg.weights["same_host"]), "process_relationship": F.lit(cfg.weights["process_relationship"]), "attack_progression": F.col("flow")}
    total = base["same_host"] + base["process_relationship"] + F.col("flow")
    return base, total, (total >= cfg.min_edge_score) & (base["process_relationship"] + F.col("flow") > 0)


def kinds(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = ()) -> DataFrame:
    """``window``, points of each signal, ``total`` and ``n``: how many edges there are of each kind; ``rows`` as ``prepared`` and stored."""
    on = ["window", *SIGNALS]
    each = lambda scored: edges_of(scored, cfg).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    special = kept(_special(rows, cfg, isolate_by))
    base, _, accepted = _plain_score(cfg)
    counted = plain(rows, cfg, isolate_by).select("n", "flow").unionByName(special.where("also_plain").select(F.lit(-1).cast("long").alias("n"), "flow")).where(accepted)
    counted = counted.select(F.lit(None).cast("string").alias("window"), *[base.get(s, F.lit(0)).cast("int").alias(s) for s in SIGNALS], "n")
    made = beside.kinds(rows, cfg, isolate_by, SIGNALS).unionByName(each(score_pairs(elsewhere(rows, cfg, isolate_by), cfg))).unionByName(each(special)).unionByName(counted)
    return made.groupBy(*on).agg(F.sum("n").alias("n")).where("n > 0").withColumn("total", sum((F.col(s) for s in SIGNALS[1:]), F.col(SIGNALS[0])))


def edges(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...] = ()) -> DataFrame:
    """``event_a, event_b, window, total`` and points of each signal of every edge; ``rows`` as ``prepared`` and stored.

    Those of one process name on a host are met by columns inside tasks; a join makes them where it has very many events.
    """
    score = ("event_a", "event_b", "window", "total", *SIGNALS)
    by = [*isolate_by, F.col("e.host").alias("host"), F.col("e.process_name").alias("process")]
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > beside.FAR_ROWS) & F.col("host").isNotNull() & F.col("process").isNotNull()).drop("n")
    on = [*isolate_by, "host", "process"]
    hot = rows.select("e", *by).join(many, on)
    apart = F.coalesce(F.col("b.sec") - F.col("a.sec") > cfg.broad_seconds, F.lit(True))
    met = hot.withColumnRenamed("e", "a").join(hot.withColumnRenamed("e", "b"), on).where(_earlier() & apart).select("a", "b")
    special = _special(rows, cfg, isolate_by).where("not also_plain")
    out = beside.edges(rows, cfg, isolate_by, SIGNALS).unionByName(beside.edges(rows, cfg, isolate_by, SIGNALS, far=True))
    for scored in (score_pairs(elsewhere(rows, cfg, isolate_by), cfg), score_pairs(met, cfg), special):
        out = out.unionByName(edges_of(scored, cfg).select(*score))
    return out


def tallied(rows: DataFrame, cfg: Settings, isolate_by: tuple[str, ...]) -> DataFrame:
    """``isolate_by, event_a, links, best``, each group's summed points and ``best_<group>`` of all edges of each earlier event; ``rows`` as ``prepared`` and stored."""
    of = lambda signals: sum((F.col(s) for s in signals[1:]), F.col(signals[0]))
    points = {g: of(signals) for g, signals in GROUPS.items()}
    on = [*isolate_by, "event_a"]

    def summed(edges: DataFrame, n: Column, points: dict[str, Column], total: Column) -> DataFrame:
        zero = F.lit(0)
        sums = [F.sum(n * points.get(g, zero)).alias(g) for g in GROUPS]
        bests = [F.max(F.when((points.get(g, zero) > 0) & (n > 0), total)).alias(f"best_{g}") for g in GROUPS]
        return edges.groupBy(*on).agg(F.sum(n).alias("links"), F.max(F.when(n > 0, total)).alias("best"), *sums, *bests)

    close = edges_of(score_pairs(elsewhere(rows, cfg, isolate_by), cfg, isolate_by), cfg)
    special = kept(_special(rows, cfg, isolate_by))
    base, total, accepted = _plain_score(cfg)
    # What a special pair also counts as a plain one is taken off again; it scores at least as much by itself.
    counted = plain(rows, cfg, isolate_by).select(*on, "n", "flow").unionByName(special.where("also_plain").select(*on, F.lit(-1).cast("long").alias("n"), "flow"))
    one = F.lit(1).cast("long")
    parts = [summed(close, one, points, F.col("total")), summed(edges_of(special, cfg), one, points, F.col("total")), summed(counted.where(accepted), F.col("n"), base, total)]
    made = beside.tallies(rows, cfg, isolate_by, GROUPS)
    for part in parts:
        made = made.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("links", *GROUPS)]
    return made.groupBy(*on).agg(*sums, *[F.max(c).alias(c) for c in ("best", *[f"best_{g}" for g in GROUPS])]).where("links > 0")
