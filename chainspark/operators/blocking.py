"""Pairs of events that can score an edge, made under the smallest sets of shared keys that can reach the threshold.

All pairs of a key are made while it has few events (``ALL_PAIRS``), so an event gets a bounded number.  The
pairs of larger keys are made by the bound, with the same edges in the end.  Within ten minutes a pair meets
under any such key it shares, by windows of time.  Further apart it needs more: from the weights follow the smallest sets of equal fields, shared process, lineage,
written file or dependency with which ``min_edge_score`` is in reach, and each set is one combined key.
So a host alone, or an account alone, never makes a pair of events that lie far apart.

Where only connection matters (``linked_pairs``), a set that makes an edge of any two events needs no pairs: one
event of its key stands for all, and each other one is linked to it.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.config import Settings
from chainspark.functions.substrings import contained
from chainspark.sinks.store import cut, kept

#: Events of a key up to which all its pairs are made.
ALL_PAIRS = 1024
#: The same where pairs only serve to connect.
LINK_PAIRS = 128
#: Equal fields by signal; the host comes first as others hang on it.
FIELDS = {"same_host": "host", "same_user": "user", "same_source_ip": "source_ip", "same_destination_ip": "destination_ip", "shared_domain": "domain", "shared_file": "file_path"}
#: What one event gives and the other takes on one host: lineage and a written file make related processes, a file and a name needed make a dependency.
LINKS = ("same_process", "lineage", "refers", "needs")
ACTED = ("LOGIN_SUCCESS", "AUTHENTICATION"), ("PROCESS_CREATED", "REMOTE_EXECUTION", "FILE_CREATED", "REGISTRY_MODIFIED")
NEEDED = {"DNS_QUERY": "domain", "NETWORK_CONNECTION": "destination_ip", "PROCESS_CREATED": "process_name"}
TAKERS = {"domain": ("FILE_CREATED", "NETWORK_CONNECTION"), "destination_ip": ("FILE_CREATED",), "process_name": ("REGISTRY_MODIFIED",)}


def minimal(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """Sets without a proper subset among them, each once."""
    once = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    return [s for s in once if not any(o < s for o in once)]


def far_sets(cfg: Settings) -> list[frozenset[str]]:
    """The smallest sets of evidence with which a pair over ten minutes apart can reach the threshold.

    Elements are fields of ``FIELDS``, the ``LINKS``, ``acted`` (a logon and a later act of its account), ``tactics`` (both
    events have one), ``hostless`` (neither has a host: related processes and dependency are taken for granted), ``loose``
    (no evidence: a dependency across a missing host is taken for granted) and ``kin`` (any entity key).  Every pair that scores
    enough has all of one of these sets.
    """
    w = cfg.weights
    worth = {f: w[s] for s, f in FIELDS.items()}
    process, dependency, progression = w["process_relationship"], w["event_dependency"], w["attack_progression"]
    found = []
    fields = [frozenset(c) for n in range(len(worth) + 1) for c in combinations(worth, n)]
    for shared in fields:
        for tactics in (False, True):
            base = sum(worth[f] for f in shared) + tactics * progression
            mark = {"tactics"} if tactics else set()
            if "host" not in shared:
                # Something shared is what brings such a pair together at all: a field, else any entity key.
                mark = mark if shared else mark | {"kin"}
                if base + dependency >= cfg.min_edge_score:
                    found.append(shared | mark | {"loose"})
                if base + process + dependency >= cfg.min_edge_score:
                    # With nothing shared that an account's acts could hang on, a dependency that is needed is a file or a name.
                    needed = [{"refers"}, {"needs"}] if not shared and base + process < cfg.min_edge_score else [set()]
                    found += [shared | mark | {"hostless"} | n for n in needed]
                continue
            for links in (c for n in range(len(LINKS) + 1) for c in combinations(LINKS, n)):
                for acted in (False, True):
                    if acted and "user" not in shared:
                        continue
                    linked = process * bool({"same_process", "lineage", "refers"} & set(links)) + dependency * (acted or bool({"refers", "needs"} & set(links)))
                    if base + linked >= cfg.min_edge_score:
                        found.append(shared | mark | set(links) | ({"acted"} if acted else set()))
    # Time and host alone make no edge, whatever they weigh.
    return minimal([s for s in found if s != {"host"}])


def told(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the file and names that an event's command contains (``holds``), among those written or needed on its host (or by any event without a host, if it has none)."""
    e = F.col("e")
    at_host = F.coalesce(e["host"], F.lit(""))
    # A written file is looked for in any command, a needed name only in those of events that can need it.
    by = lambda kind: F.concat(F.lit(kind), at_host)
    kinds = {f: str(i) for i, f in enumerate(TAKERS)}
    item = lambda kind, value: F.struct(by(kind).alias("by"), value.alias("needle"))
    given = F.array(item("m", e["made"]), *[item(kinds[f], F.when(e["event_type"] == t, e[f])) for t, f in NEEDED.items()])
    asked = F.array_compact(F.array(by("m"), *[F.when(e["event_type"].isin(*types), by(kinds[f])) for f, types in TAKERS.items()]))
    texts = keyed.where("e.command <> ''").select(F.explode(asked).alias("by"), e["command"].alias("text")).distinct()
    needles = keyed.select(F.inline(given)).where("needle is not null").distinct().join(texts.select("by").distinct(), "by", "left_semi")
    found = contained(needles, texts).select(F.expr("substring(by, 2)").alias("by"), "text", "needle").groupBy("by", "text").agg(F.collect_set("needle").alias("holds"))
    # Joined by a number for the text, which the texts themselves confirm.
    found = found.select(F.xxhash64("by", "text").alias("at"), F.col("by").alias("on_host"), F.col("text").alias("of"), "holds")
    at = F.when(e["command"] != "", F.xxhash64(at_host, e["command"]))
    met = keyed.withColumn("at", at).join(found, "at", "left")
    right = (F.col("on_host") == at_host) & (F.col("of") == e["command"])
    none = F.array().cast("array<string>")
    return met.withColumn("holds", F.when(F.coalesce(right, F.lit(False)), F.col("holds")).otherwise(none)).drop("at", "on_host", "of")


def _combined(tag: int, values: list[Column | tuple[Column]]) -> Column:
    """Keys for every choice of one value each, of plain columns and of arrays (as tuples of one); none where one is missing."""
    single, many = [v for v in values if not isinstance(v, tuple)], [v[0] for v in values if isinstance(v, tuple)]
    none = F.array().cast("array<bigint>")
    sure = F.lit(True)
    for v in single:
        sure = sure & v.isNotNull()
    out = F.array(F.xxhash64(F.lit(tag), *single))
    each = lambda v: lambda head: F.transform(v, lambda x: F.xxhash64(head, x))
    for v in many:
        out = F.flatten(F.transform(out, each(v)))
    return F.when(sure, out).otherwise(none)


def _one(value: Column, tag: str = "") -> Column:
    """A present value as an array of one."""
    return F.when(value.isNotNull(), F.array(F.concat(F.lit(tag), value.cast("string")))).otherwise(F.array().cast("array<string>"))


def far_keys(sets: list[frozenset[str]], fields: Column | None = None) -> tuple[Column, Column]:
    """Combined keys of an event ``e`` as the earlier and as the later of a pair; a pair that has all of one of ``sets`` shares one.

    ``fields`` has the values by which events meet, where they are not those of ``e``.
    """
    e = F.col("e")
    at = e if fields is None else fields
    yes = lambda when: F.when(when, F.lit(""))
    names = F.array_distinct(F.concat("holds", _one(e["process_name"])))
    tagged = lambda tag, values: F.transform(values, lambda x: F.concat(F.lit(tag), x))
    own = [_one(F.when(e["event_type"] == t, e[f]), f"{f}>") for t, f in NEEDED.items()]
    takes = [F.when(e["event_type"].isin(*TAKERS[f]), tagged(f"{f}>", F.col("holds"))).otherwise(F.array().cast("array<string>")) for f in NEEDED.values()]
    both = {
        **{f: (at[f], at[f]) for f in FIELDS.values()},
        "same_process": (e["process_name"], e["process_name"]),
        "lineage": ((F.concat(_one(e["process_id"], "p"), _one(e["parent_process_id"], "c")),), (F.concat(_one(e["parent_process_id"], "p"), _one(e["process_id"], "c")),)),
        "refers": ((F.concat(_one(e["made"], "m"), tagged("u", names)),), (F.concat(tagged("m", names), _one(e["made"], "u")),)),
        "needs": ((F.concat(*own),), (F.concat(*takes),)),
        "acted": (yes(e["event_type"].isin(*ACTED[0])), yes(e["event_type"].isin(*ACTED[1]))),
        "tactics": (yes(e["idx"].isNotNull()), yes(e["idx"].isNotNull())),
        "hostless": (yes(e["host"].isNull()), yes(e["host"].isNull())),
        "loose": (F.lit(""), F.lit("")),
        "kin": ((F.col("hot"),), (F.col("hot"),)),
        "seeds": (yes(e["seed"]), yes(e["seed"])),
        "one_seed": (e["seed"].cast("string"), (~e["seed"]).cast("string")),
    }
    sides = []
    for side in (0, 1):
        made = [_combined(i, [both[x][side] for x in sorted(s)]) for i, s in enumerate(sets)]
        sides.append(F.array_distinct(F.concat(*made)) if made else F.array().cast("array<bigint>"))
    return sides[0], sides[1]


def _meet(left: DataFrame, right: DataFrame, isolate_by: tuple[str, ...], when: Column) -> DataFrame:
    """Pairs under the smallest of ``keys`` that the left's and the right's have in common, if they share none of ``small``."""
    side = lambda df, x: df.select(F.col("e").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("keys", "small") if c in df.columns], F.explode("keys").alias("key"), *isolate_by)
    met = side(left, "a").join(side(right, "b"), ["key", *isolate_by])
    met = met.where(when & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))))
    apart = ~F.arrays_overlap("small_a", "small_b") if "small" in left.columns else F.lit(True)
    return met.where(apart).select("a", "b", *isolate_by)


def with_hot(keyed: DataFrame, isolate_by: tuple[str, ...], most: int) -> DataFrame | None:
    """``keyed`` with its ``hot`` keys (those of more than ``most`` events) and the others as ``small``; None if no key is hot."""
    each = keyed.select(F.col("e.event_id").alias("id"), F.explode("keys").alias("key"), *isolate_by)
    on = ["key", *isolate_by]
    hot = cut(each.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*on))
    if hot.isEmpty():
        return None
    own = each.join(hot, on).groupBy("id", *isolate_by).agg(F.collect_set("key").alias("hot"))
    joined = keyed.withColumn("id", F.col("e.event_id")).join(own, ["id", *isolate_by], "left")
    joined = joined.withColumn("hot", F.coalesce("hot", F.array().cast("array<bigint>")))
    return joined.select("e", "keys", "hot", F.array_except("keys", "hot").alias("small"), *isolate_by)


def bound_pairs(keyed: DataFrame, cfg: Settings, ordered: Column, isolate_by: tuple[str, ...] = (), most: int = ALL_PAIRS) -> DataFrame:
    """Pairs (structs ``a`` before ``b``) of events (``e`` with its entity ``keys``) that share an entity key and can reach the threshold."""
    told_hot = with_hot(keyed, isolate_by, most)
    if told_hot is None:
        return _meet(keyed, keyed, isolate_by, ordered)
    return _bound(kept(told_hot), far_sets(cfg), cfg, ordered, isolate_by)[0]


def _bound(told_hot: DataFrame, sets: list[frozenset[str]], cfg: Settings, ordered: Column, isolate_by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Pairs under small keys, within windows of time, and under ``sets`` further apart; and the events of hot keys with what they hold."""
    few = told_hot.select("e", F.col("small").alias("keys"), *isolate_by)
    pairs = _meet(few, few, isolate_by, ordered)
    many = told_hot.where(F.size("hot") > 0)
    width = cfg.broad_seconds
    gap = F.abs(F.col("a.sec") - F.col("b.sec"))
    # A time lies in two windows of twice the width; times at most a width apart share one.
    bucket = F.floor(F.col("e.sec") / width)
    windows = F.flatten(F.transform("hot", lambda k: F.array(F.xxhash64(k, bucket), F.xxhash64(k, bucket + 1))))
    timed = many.where("e.sec is not null").select("e", "small", windows.alias("keys"), *isolate_by)
    near = _meet(timed, timed, isolate_by, ordered & (gap <= width))
    rows = kept(told(many))
    side = lambda c: rows.select("e", "small", c.alias("keys"), *isolate_by)
    first, second = far_keys(sets)
    far = _meet(side(first), side(second), isolate_by, ordered & F.coalesce(gap > width, F.lit(True)))
    return pairs.unionByName(near).unionByName(far), rows


def is_sure(s: frozenset[str], cfg: Settings, least: int) -> bool:
    """Whether any two events that have all of the set score at least ``least``, whatever their order and time, with evidence beyond host."""
    if not s <= {*FIELDS.values(), "same_process", "lineage", "refers"} or "host" not in s:
        return False
    own = {f: cfg.weights[signal] for signal, f in FIELDS.items()}
    linked = s - own.keys()
    beyond = sum(own[f] for f in s & own.keys() if f != "host") + cfg.weights["process_relationship"] * bool(linked)
    return len(linked) <= 1 and beyond > 0 and beyond + own["host"] >= least


def _exactly(values: list[Column]) -> Column:
    """A text that two lists of values share only if they are equal; null where one is missing."""
    return F.concat(*[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values])


def stars(rows: DataFrame, sets: list[tuple[frozenset[str], bool]], isolate_by: tuple[str, ...], values: Column | None = None, of: Column | None = None) -> DataFrame:
    """``event_a, event_b``: what connects the events that share a sure set as all their pairs would; with ``True``, of those pairs where one event is seeded.

    Under one key all pairs are edges, of any two events or of any that gives with any that takes, so one
    event a side stands for it: a seeded one if there is any, then the smallest.  With ``of``, what it names is linked instead of events.
    """
    e = F.col("e")
    named = e["event_id"] if of is None else of
    at = e if values is None else values
    fields = set(FIELDS.values())
    names = F.array_distinct(F.concat("holds", _one(e["process_name"])))
    sides = {"lineage": (_one(e["process_id"]), _one(e["parent_process_id"])), "refers": (_one(e["made"]), names)}
    made = []
    for i, (s, seeded) in enumerate(sets):
        base = [F.lit(str(i)), *[at[f] for f in sorted(s & fields)], *[e["process_name"] for x in s if x == "same_process"]]
        link = next((x for x in s if x in sides), None)
        item = lambda side, key, seeded=seeded: F.struct(F.lit(side).alias("side"), F.lit(seeded).alias("seeded"), key.alias("key"))
        items = lambda side, base=base: lambda v: item(side, _exactly([*base, v]))
        if link is None:
            made.append(F.array(item(2, _exactly(base))))
        else:
            made += [F.transform(values, items(side)) for side, values in enumerate(sides[link])]
    if not made:
        return rows.select(named.alias("event_a"), named.alias("event_b")).where("false")
    each = rows.select(named.alias("id"), e["seed"].alias("seed"), *isolate_by, F.inline(F.flatten(F.array(*made)))).where("key is not null")
    on = ["key", *isolate_by]
    if of is not None:
        each = each.groupBy("id", *on, "side", "seeded").agg(F.max("seed").alias("seed"))
    of = lambda side: F.min(F.when(F.col("side") == side, F.struct((~F.col("seed")).alias("plain"), "id")))
    heads = each.groupBy(*on).agg(of(0).alias("giver"), of(1).alias("taker"), of(2).alias("any"), F.count(F.lit(1)).alias("n")).where("n > 1")
    head = F.when(F.col("side") == 0, F.col("taker")).when(F.col("side") == 1, F.col("giver")).otherwise(F.col("any"))
    met = each.join(heads, on).select("id", "seed", "seeded", head.alias("head")).where("head is not null and head.id <> id and (not seeded or seed or not head.plain)")
    return met.select(F.col("id").alias("event_a"), F.col("head.id").alias("event_b"))


def link_sets(cfg: Settings, strong: bool) -> tuple[list, list, list]:
    """Sets of evidence of links further apart: those whose pairs must be scored, those that make an edge of any two events, and of any two seeded ones."""
    higher = max(cfg.min_edge_score, cfg.absorb_score)
    levels = [(cfg.min_edge_score, "seeds"), (higher, "one_seed")] if strong else [(cfg.min_edge_score, None)]
    open_sets, sure, seeds = [], [], []
    for least, mark in levels:
        found = far_sets(replace(cfg, min_edge_score=least))
        open_sets += [s | ({mark} if mark else set()) for s in found if not is_sure(s, cfg, least)]
        (seeds if mark == "seeds" else sure).extend((s, mark is not None) for s in found if is_sure(s, cfg, least))
    return open_sets, sure, seeds


def linked_pairs(keyed: DataFrame, cfg: Settings, ordered: Column, isolate_by: tuple[str, ...], strong: bool, most: int = LINK_PAIRS) -> tuple[DataFrame, DataFrame | None]:
    """Pairs still to be scored, and pairs of ids that are edges: together they connect what all edges connect.

    With ``strong``, edges between two seeded events, or of one seeded event with at least ``absorb_score``.
    """
    told_hot = with_hot(keyed, isolate_by, most)
    if told_hot is None:
        return _meet(keyed, keyed, isolate_by, ordered), None
    open_sets, sure, seeds = link_sets(cfg, strong)
    pairs, rows = _bound(kept(told_hot), open_sets, cfg, ordered, isolate_by)
    links = stars(rows, sure, isolate_by)
    if seeds:
        links = links.unionByName(stars(rows.where("e.seed"), seeds, isolate_by))
    return pairs, links
