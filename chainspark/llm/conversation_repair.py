"""Conversation repair: the cheapest edits that give a conversation a legal order of roles.

A weighted deduction system in the manner of Knuth.  The item *(i, q)* stands for the lightest way to
finish a conversation from its row *i* on when the last role put out was *q*.  Each edit is a
deduction: from *(i+1, q')* keeping or re-roling row *i*, from *(i+1, q)* deleting it, from *(i, q')*
inserting a row before it.  The agenda pops items by (cost, rows covered, audit); every deduction
raises cost or rows and so is a superior function, an item is final when it is popped, and the
search ends when the goal *(0, start)* is.  From one item each letter leads to one item only,
so the least audit among the cheapest is told by its first letter.

Conversations of up to ``ROWS`` rows are solved one by one inside tasks.  Longer ones, which may hold
a third of the table, are cut into segments: each gives its costs between roles, the costs are
chained from the last segment to the first, the segments are solved once more with what is to come.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import durable

ROWS = 4096
BYTES = 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role an edit puts out after each state, and the states it can follow.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {q: [p for p in STATES if MADE[p] == q] for q in STATES}
#: Rows kept by their initial: the state they lead to, and those they can follow.
KEPT = {"s": (SYSTEM, (START,)), "u": (USER, BEFORE[USER]), "a": (ASSISTANT, BEFORE[ASSISTANT])}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A conversation may end before its first row or after an assistant.
ENDS = (0, None, None, 0)
LEGAL = {"su", "ua", "au"}
MUST_GO = "x"
BLANK = " \t\n\x0b\x0c\r"

REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


class Edit(NamedTuple):
    letter: str
    row: int
    state: int


def derive(symbols: str, ends: tuple[int | None, ...] = ENDS, goals: tuple[int, ...] = (START,)) -> dict[int, tuple[int, list[Edit], int]]:
    """For each goal state that can be finished: cost, edits in order, and the state after the last row.

    ``symbols`` has a letter a row: its role's initial (``o``: any other), upper case where the text is
    cut off, ``x`` where the row must go.  ``ends`` are the costs of what follows, by state.
    """
    rows = len(symbols)
    agenda = [(cost, 0, "", rows << 2 | q, -1) for q, cost in enumerate(ends) if cost is not None]
    heapq.heapify(agenda)
    final: dict[int, tuple[int, str, int]] = {}
    open_goals = set(goals)
    while agenda and open_goals:
        cost, covered, letter, item, after = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, letter, after
        at, state = item >> 2, item & 3
        if at == 0:
            open_goals.discard(state)
        for p in BEFORE[state]:
            heapq.heappush(agenda, (cost + INSERT, covered, "I", at << 2 | p, item))
        if at == 0:
            continue
        symbol, at = symbols[at - 1], at - 1
        heapq.heappush(agenda, (cost + DELETE, covered + 1, "D", at << 2 | state, item))
        if symbol == MUST_GO:
            continue
        extra = TRUNCATED * symbol.isupper()
        for p in BEFORE[state]:
            heapq.heappush(agenda, (cost + REROLE + extra, covered + 1, "R", at << 2 | p, item))
        to, follows = KEPT.get(symbol.lower(), (None, ()))
        if to == state:
            for p in follows:
                heapq.heappush(agenda, (cost + KEEP + extra, covered + 1, "K", at << 2 | p, item))
    out = {}
    for goal in goals:
        if goal in final:
            edits, item = [], goal
            while final[item][1]:
                _, letter, after = final[item]
                edits.append(Edit(letter, item >> 2, after & 3))
                item = after
            out[goal] = final[goal][0], edits, item & 3
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of the benchmark's damage; ``copies`` is 0 for a dropped row and 2 for a repeated one.

    A null role or text becomes one space, a null id or turn does so in the row's number.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(h == 4, "user").otherwise(name("role"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial")


def fault() -> Column:
    """``blank``, ``truncated`` or null, by the text alone."""
    end = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    return F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").alias("fault")


def symbol(first: str, found: str | None) -> str:
    return MUST_GO if found in ("blank", "duplicate") else first.upper() if found else first


class Solver:
    """Edits by symbols; sequences of up to 32 rows are remembered, 50,000 of them."""

    def __init__(self):
        self.known: dict[str, tuple[int, list[Edit]]] = {}

    def __call__(self, symbols: str) -> tuple[int, list[Edit]]:
        found = self.known.get(symbols)
        if found is None:
            cost, edits, _ = derive(symbols)[START]
            found = cost, edits
            if len(symbols) <= 32:
                if len(self.known) >= 50_000:
                    self.known.clear()
                self.known[symbols] = found
        return found


def repair_one(rows: list[dict], solve: Solver) -> dict:
    """A conversation's counts and repaired rows; ``rows`` in order, with ``copies``, ``initial`` and ``fault``."""
    laid = [r for r in rows for _ in range(r["copies"])]
    seen: set[tuple[str, str]] = set()
    faults = []
    for r in laid:
        key = r["role"], r["text"]
        faults.append("blank" if r["fault"] == "blank" else "duplicate" if key in seen else r["fault"])
        seen.add(key)
    firsts = "".join(r["initial"] for r in laid)
    turns = {r["turn"] for r in laid} - {None}
    cost, edits = solve("".join(map(symbol, firsts, faults)))
    kept = [e for e in edits if e.letter != "D"]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:])),
        "cost": cost,
        "audit": "".join(e.letter for e in edits),
        "roles": [laid[e.row]["role"] if e.letter == "K" else NAMES[e.state] for e in kept],
        "texts": ["" if e.letter == "I" else laid[e.row]["text"] for e in kept],
    }


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, segment: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repairs of the conversations in ``rows`` (``conv_id, turn, role, text, copies``).

    Gives one row a conversation with its repaired ``roles`` and ``texts``; one row (without these) for
    each conversation of over ``most_rows`` rows or ``most_bytes`` of text; and the repaired rows of the latter
    (``conv_id, segment, step, role, text``).  Rows stand by turn, nulls first, then by role and text,
    copies side by side.  Null ids are one conversation.  A conversation without rows has
    zeros and no edits; an empty table gives no rows; other columns are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    large = durable(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("large_id")))
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    short = rows.join(large, same, "left_anti")
    row = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies", initial(), fault()))
    grouped = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, found = batch.slice(at, 64).columns
                done = [repair_one(r, solver) for r in found.to_pylist()]
                columns = [pa.array([d[c] for d in done], kind) for c, kind in kinds]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["conv_id", *(c for c, _ in kinds)])

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [*((c, pa.int64()) for c in counts), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    solved = grouped.mapInArrow(solve, REPAIRED)
    if large.isEmpty():
        none = solved.where("false")
        return solved, none.drop("roles", "texts"), none.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(0).alias("step"), F.lit("").alias("role"), F.lit("").alias("text"))
    return solved, *repair_large(rows.join(large, same, "left_semi"), segment)


def placed(rows: DataFrame) -> DataFrame:
    """Rows of large conversations in order: ``place`` grows along ``conv_id, turn, role, text``; copies after the first carry no text."""
    alike = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    alike = durable(alike.withColumns({"digest": F.sha2("text", 256), "since": F.struct("turn")}))
    first = alike.groupBy("conv_id", "role", "digest").agg(F.min("since").alias("first"))
    on = alike["conv_id"].eqNullSafe(first["conv_id"]) & (alike["role"] == first["role"]) & (alike["digest"] == first["digest"])
    each = alike.join(first, on).select(alike["*"], "first", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    found = F.when(fault() == "blank", "blank").when((F.col("copy") > 1) | (F.col("since") > F.col("first")), "duplicate").otherwise(fault())
    out = each.select("conv_id", "turn", "role", "text", "copy", initial(), found.alias("fault"))
    order = ["conv_id", "turn", "role", "text", "copy"]
    laid = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return durable(laid.withColumn("text", F.when(F.col("copy") == 1, F.col("text"))))


def repair_large(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired rows of large conversations; ``size`` rows a segment, a power of two."""
    laid = placed(rows).withColumn("segment", F.floor(F.col("place") / size))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault").isNotNull(), F.upper("initial")).otherwise(F.col("initial"))
    run = F.sort_array(F.collect_list(F.struct("place", letter.alias("symbol"), "initial")))
    joined = lambda c: F.array_join(F.transform("run", lambda r: r[c]), "").alias(f"{c}s")
    segments = durable(laid.groupBy("conv_id", "segment").agg(run.alias("run")).select("conv_id", "segment", joined("symbol"), joined("initial"), F.transform("run", lambda r: r["place"]).alias("places")))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cost from each state before a segment to each after it, row by row."""
        for batch in batches:
            out = []
            for symbols in batch.column("symbols").to_pylist():
                ways = [derive(symbols, tuple(0 if q == e else None for q in STATES), STATES) for e in STATES]
                out.append([ways[e][q][0] if q in ways[e] else None for q in STATES for e in STATES])
            yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "segment"]).columns, pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "segment", "costs"])

    def backward(table: pa.Table) -> pa.Table:
        """What is to come after each segment; one small row for each of a conversation's segments."""
        table = table.sort_by([("segment", "descending")])
        ahead, out = list(ENDS), []
        for m in table.column("costs").to_pylist():
            out.append(ahead)
            sums = [[m[q * 4 + e] + ahead[e] for e in STATES if m[q * 4 + e] is not None and ahead[e] is not None] for q in STATES]
            ahead = [min(s, default=None) for s in sums]
        return table.drop_columns("costs").append_column("ahead", pa.array(out, pa.list_(pa.int64())))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edits of each segment from each state before it: letters, rows, states; the state after it."""
        for batch in batches:
            for conv, segment, symbols, ahead in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "symbols", "ahead"))):
                for q, (cost, edits, end) in derive(symbols, tuple(ahead), STATES).items():
                    row = {"conv_id": conv, "segment": segment, "before": q, "after": end, "cost": cost, "audit": "".join(e.letter for e in edits), "rows": [e.row for e in edits], "states": [e.state for e in edits]}
                    yield pa.RecordBatch.from_pylist([row], schema=way_kind)

    def forward(table: pa.Table) -> pa.Table:
        """The state before each segment on the cheapest way."""
        after = {(s, q): e for s, q, e in zip(*(table.column(c).to_pylist() for c in ("segment", "before", "after")))}
        state, out = START, []
        for s in sorted({s for s, _ in after}):
            out.append((s, state))
            state = after[s, state]
        conv = pa.array([table.column("conv_id")[0].as_py()] * len(out), pa.int64())
        return pa.table([conv, pa.array([s for s, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int32())], names=["conv_id", "segment", "before"])

    way_kind = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("rows", pa.list_(pa.int32())), ("states", pa.list_(pa.int32()))])
    ways_ddl = "conv_id long, segment long, before int, after int, cost long, audit string, rows array<int>, states array<int>"
    between = segments.select("conv_id", "segment", "symbols").mapInArrow(costs, "conv_id long, segment long, costs array<long>")
    ahead = between.groupBy("conv_id").applyInArrow(backward, "conv_id long, segment long, ahead array<long>")
    # Conversations can share a segment's number; a null id is one of its own.
    key = F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"), F.isnull("conv_id").alias("none"), "segment").alias("at")
    ways = segments.withColumn("at", key).join(ahead.select(key, "ahead"), "at").mapInArrow(solved, ways_ddl)
    ways = durable(ways.withColumn("at", key))
    chosen = ways.select("conv_id", "segment", "before", "after").groupBy("conv_id").applyInArrow(forward, "conv_id long, segment long, before int").select(key, F.col("before").alias("from"))
    picked = durable(ways.join(chosen, "at").where("before = from").drop("from").join(segments.select(key, "places", "initials"), "at").drop("at"))
    edits = picked.select("conv_id", "segment", "places", F.posexplode(F.arrays_zip(F.split("audit", "").alias("letter"), "rows", "states")).alias("step", "e"))
    edits = edits.where("e.letter != 'D' and e.letter != ''").select("conv_id", "segment", "step", F.col("e.letter").alias("letter"), F.col("e.states").alias("state"), F.get("places", F.col("e.rows")).alias("place"))
    names = F.when(F.col("state") == USER, NAMES[USER]).otherwise(NAMES[ASSISTANT])
    texts = laid.select("place", F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    made = edits.where("letter = 'I'").select("conv_id", "segment", "step", names.alias("role"), F.lit("").alias("text"))
    kept = edits.where("letter != 'I'").join(texts, "place")
    kept = kept.select("conv_id", "segment", "step", F.when(F.col("letter") == "K", F.col("own_role")).otherwise(names).alias("role"), F.col("own_text").alias("text"))
    return large_summary(laid, picked), made.unionByName(kept)


def large_summary(laid: DataFrame, picked: DataFrame) -> DataFrame:
    """Counts, cost and audit of large conversations."""
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.countDistinct("turn")
    tally = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    counts = laid.groupBy("conv_id").agg(turns.alias("gaps"), *tally)
    parts = F.sort_array(F.collect_list(F.struct("segment", "cost", "audit", "initials")))
    chain = picked.groupBy("conv_id").agg(parts.alias("p"))
    firsts = F.array_join(F.transform("p", lambda s: s["initials"]), "")
    # Each pair of neighbours is looked at once: two letters from every place.
    bad = F.length(firsts) - 1 - F.regexp_count(firsts, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    whole = chain.select(F.col("conv_id").alias("id"), bad.cast("long").alias("illegal"), F.get("p", F.lit(0))["cost"].alias("cost"), F.array_join(F.transform("p", lambda s: s["audit"]), "").alias("audit"))
    return counts.join(whole, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


def repaired_hashes(lines: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows, read in order; a digest is one sequence by its nature, but no text is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, digest):
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        conv, digest = None, None
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if digest is None or c != conv:
                    if digest is not None:
                        yield row(conv, digest)
                    conv, digest = c, sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
        if digest is not None:
            yield row(conv, digest)

    order = ["conv_id", "segment", "step"]
    return lines.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def digests(repaired: DataFrame, large: DataFrame, lines: DataFrame) -> DataFrame:
    joined = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    short = repaired.select("*", F.sha2(joined, 256).alias("repaired_sha256")).drop("roles", "texts")
    hashes = repaired_hashes(lines).withColumnRenamed("conv_id", "id")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return short.unionByName(large.join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(*large.columns, digest))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
