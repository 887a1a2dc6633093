"""Exact n-gram Jaccard join as a metric-space join, and its components.

Jaccard distance is a metric, and two documents link at distance 0.2 or less.  Almost all
pairs of documents lie at distance exactly 1, where a pivot drawn from the documents says nothing,
so the space is cut in two steps:

1. *Regions.*  Ordered by corpus frequency, two linked sets share one of the
   ``n - ceil(0.8 n) + 1`` rarest shingles of each.  The smallest document with such a
   shingle is its pivot, and a document is replicated to every pivot it shares one with, so
   both ends of a link meet in a region.  A shingle found in one document leads nowhere, so most
   documents end here.
2. *Voronoi cells.*  A region over ``cap`` shingles draws pivots.  A document nearer than 0.8 to
   its nearest pivot has that cell for its home; by the triangle inequality a link leads to a
   document at most twice the radius further from that pivot than from its own nearest, and no
   further than the cell's outermost document plus the radius: such boundary documents are
   replicated.  Documents without a home meet in a cell of their own.  Cells are cut again until
   they are small; a cell that does not shrink is cut in blocks that each meet the same few
   pivots, round by round.

In a small cell, a pivot is measured against the others; those whose distances to earlier pivots
differ by more than the radius are left out.  Links to the pivot join components, and a document
in the largest component needs no pivot of its own, as any link to another component has its
other end outside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import (
    REQUEST,
    SIMILARITY_PERCENT,
    Words,
    bucket_count,
    count_keys,
    distinct_counts,
    documents,
    durable,
    fresh,
    in_buckets,
    key_bytes,
    leading,
    replies,
    requests,
    shingle_hashes,
    slices,
    text_bytes,
)
from chainspark.llm.components import connected_components

CAP = 2_000_000
PIVOTS = 64
SALTS = 32
SETS = "doc_id long, n_shingles long, class binary, keys array<long>, shingles binary"


def sets_of(texts: pa.Table) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    out = []
    for piece in slices(texts, "text"):
        words = Words(piece.column("text"))
        out += [np.unique(shingle_hashes(words.hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:])]
    return out


def rare_keys(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Per document its set size, a class (equal for equal sets), and its rarest shared shingles.

    ``shingles`` is filled only where ``keys`` has any.
    """
    weight = text_bytes(docs)
    buckets, width = bucket_count(docs, weight), key_bytes(weight // 6, 10)
    bucketed = in_buckets(docs.where("doc_id is not null"), buckets)

    def distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return distinct_counts(leading(np.concatenate(sets) if sets else np.zeros(0, np.uint64), width))

    def pick(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sets = sets_of(texts)
        keys, _ = distinct(sets)
        (counts,), _ = replies(answers)
        out = []
        for s in sets:
            n = len(s)
            often = counts[np.searchsorted(keys, leading(s, width))] if n else np.zeros(0, np.int64)
            prefix = n - -(-percent * n // 100) + 1
            lead = np.lexsort((s, often))[:prefix]
            shared = s[lead[often[lead] > 1]]
            out.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), shared.view(np.int64), s.tobytes() if len(shared) else None))
        return pa.table(
            {
                "doc_id": texts.column("doc_id").cast(pa.int64()),
                "n_shingles": pa.array([x[0] for x in out], pa.int64()),
                "class": pa.array([x[1] for x in out], pa.binary()),
                "keys": pa.array([x[2] for x in out], pa.list_(pa.int64())),
                "shingles": pa.array([x[3] for x in out], pa.binary()),
            }
        )

    ask = lambda t: requests(t.column("bucket")[0].as_py(), [distinct(sets_of(t))], buckets, (width,))
    counted = count_keys(bucketed.groupBy("bucket").applyInArrow(ask, REQUEST), buckets, (width,))
    return bucketed.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(pick, SETS)


# ------------------------------------------------------------------ one region


class Region:
    """Sets of one region (or block of it) over a common numbering of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.heads = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.universe, self.members = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.universe) + 1, np.int32)

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of every set with ``s``."""
        at = np.searchsorted(self.universe, s)
        at = at[(at < len(self.universe)) & (self.universe[np.minimum(at, len(self.universe) - 1)] == s)]
        self.mark[at] = 1
        out = np.add.reduceat(self.mark[self.members], self.heads)
        self.mark[at] = 0
        return out.astype(np.int64)


def region_components(sets: list[np.ndarray], percent: int = SIMILARITY_PERCENT, remembered: int = 8) -> np.ndarray:
    """Label (index of the first member) of each set's component under the link rule."""
    n, region, radius = len(sets), Region(sets), 1 - percent / 100 + 1e-9
    label, done, seen = np.arange(n), np.zeros(n, bool), []
    while True:
        largest = np.bincount(label, minlength=n).argmax()
        open_ = np.flatnonzero((label != largest) & ~done)
        if not len(open_):
            return label
        # The next pivot lies farthest from the earlier ones.
        q = open_[np.min([d[open_] for d in seen], axis=0).argmax()] if seen else open_[0]
        near = (percent * region.sizes <= 100 * region.sizes[q]) & (percent * region.sizes[q] <= 100 * region.sizes)
        for d in seen:
            near &= np.abs(d - d[q]) <= radius
        done[q] = True
        if not (near & (label != label[q])).any() and len(seen) >= remembered:
            continue
        both = region.shared(sets[q])
        union = region.sizes + region.sizes[q] - both
        joined = np.unique(label[near & (100 * both >= percent * union)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
        if len(seen) < remembered:
            seen.append(1 - both / union)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _small(table: pa.Table, percent: int) -> pa.Table:
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    label = region_components(_sets(table.column("shingles")), percent)
    ids = table.column("doc_id").to_numpy()
    return pa.table({"a": pa.array(ids), "b": pa.array(ids[label])})


def _in_blocks(members: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """Members of large cells with their cell's size, each cell dealt over blocks of about ``cap`` shingles."""
    blocks = F.ceil(F.col("weight") / cap).cast("int").alias("blocks")
    return members.join(sizes.select("cell", "docs", "weight", blocks), "cell").withColumn("block", F.pmod(F.xxhash64("doc_id", "cell"), F.col("blocks")).cast("int"))


def _drawn(waiting: DataFrame, pivots: int, turn: int) -> DataFrame:
    """About ``pivots`` members of each cell, and its smallest, drawn anew each turn."""
    luck = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
    counted = waiting.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    drawn = waiting.join(counted, "cell").where((luck * F.col("n") < pivots) | (F.col("doc_id") == F.col("least")))
    return drawn.select("cell", "doc_id").distinct()


def _to_blocks(sized: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen members as pivots, sent to every block of their cell."""
    sent = sized.join(chosen, ["cell", "doc_id"], "left_semi").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.select(F.col("cell").alias("to"), "at", F.col("doc_id").alias("pivot"), F.col("shingles").alias("set"))


def _shared_with(block: pa.Table, chosen: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members, pivots, and sizes of intersection and union of each pivot (row) with each member."""
    region = Region(_sets(block.column("shingles")))
    sets = _sets(chosen.column("set"))
    both = np.stack([region.shared(s) for s in sets])
    union = region.sizes[None, :] + np.array([len(s) for s in sets])[:, None] - both
    return block.column("doc_id").to_numpy(), chosen.column("pivot").to_numpy(), both, union


def _links(members: np.ndarray, pivots: np.ndarray, both: np.ndarray, union: np.ndarray, percent: int) -> list[tuple[int, int]]:
    row, at = np.nonzero((100 * both >= percent * union) & (members[None, :] != pivots[:, None]))
    return list(zip(members[at].tolist(), pivots[row].tolist()))


HOMES = "cell long, doc_id long, home long, least double, near array<struct<pivot:long,d:double>>, linked array<long>"


def voronoi_cells(members: DataFrame, sizes: DataFrame, percent: int, cap: int, pivots: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Cut large cells once: their new cells (``parent`` kept), and links to pivots met on the way."""
    radius = 1 - percent / 100 + 1e-9
    sized = durable(_in_blocks(members, sizes, cap))
    chosen = durable(_drawn(sized.select("cell", "doc_id"), pivots, turn))

    def measure(block: pa.Table, pivot_sets: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows:
            ids, pivot, both, union = _shared_with(block, pivot_sets)
            d = 1 - both / union
            least = d.min(axis=0)
            linked: dict[int, list[int]] = {}
            for a, b in _links(ids, pivot, both, union, percent):
                linked.setdefault(a, []).append(b)
            for j, (i, m) in enumerate(zip(ids.tolist(), least.tolist())):
                close = np.flatnonzero((d[:, j] < 1) & (d[:, j] <= m + 2 * radius))
                home = int(pivot[d[:, j].argmin()]) if m < 1 - radius else None
                rows.append((i, home, m, [{"pivot": int(pivot[c]), "d": float(d[c, j])} for c in close], linked.get(i, [])))
        cell = block.column("cell")[0].as_py() if block.num_rows else None
        columns = [[cell] * len(rows), *(zip(*rows) if rows else [()] * 5)]
        near = pa.list_(pa.struct([("pivot", pa.int64()), ("d", pa.float64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), near, pa.list_(pa.int64()))
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["cell", "doc_id", "home", "least", "near", "linked"])

    homes = durable(sized.groupBy("cell", "block").cogroup(_to_blocks(sized, chosen).groupBy("to", "at")).applyInArrow(measure, HOMES))
    reach = homes.where("home is not null").groupBy("cell", F.col("home").alias("pivot")).agg(F.max("least").alias("reach"))
    met = homes.select("cell", "doc_id", F.inline("near")).join(reach, ["cell", "pivot"]).where(F.col("d") <= F.col("reach") + radius)
    inside = met.select("cell", "doc_id", F.xxhash64("cell", "pivot", F.lit(turn)).alias("to"))
    inside = inside.unionByName(homes.where("home is null").select("cell", "doc_id", F.xxhash64("cell", F.lit("rest"), F.lit(turn)).alias("to")))
    cut = inside.join(sized.select("cell", "doc_id", "n_shingles", F.col("weight").alias("parent")), ["cell", "doc_id"])
    return cut.drop("cell").withColumnRenamed("to", "cell"), homes.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b"))


def _by_blocks(members: DataFrame, sizes: DataFrame, links: DataFrame, percent: int, cap: int, pivots: int) -> DataFrame:
    """Links (a spanning set, beside those given) of cells that do not shrink: rounds of pivots against blocks."""
    sized = durable(_in_blocks(members, sizes, cap))
    used = sized.sparkSession.createDataFrame([], "cell long, doc_id long")

    def measure(block: pa.Table, chosen: pa.Table) -> pa.Table:
        pairs = _links(*_shared_with(block, chosen), percent) if block.num_rows and chosen.num_rows else []
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    turn = 0
    while True:
        turn += 1
        component = connected_components(links).withColumnRenamed("v", "doc_id")
        label = sized.select("cell", "doc_id").join(component, "doc_id", "left")
        label = durable(label.select("cell", "doc_id", F.coalesce("component", "doc_id").alias("component")))
        count = label.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = count.groupBy("cell").agg(F.max_by("component", "n").alias("largest"))
        waiting = label.join(largest, "cell").where("component <> largest").join(used, ["cell", "doc_id"], "left_anti")
        waiting = durable(waiting.select("cell", "doc_id"))
        if waiting.isEmpty():
            return links
        chosen = durable(_drawn(waiting, 2 * pivots, turn))
        used = durable(used.union(chosen))
        found = sized.groupBy("cell", "block").cogroup(_to_blocks(sized, chosen).groupBy("to", "at")).applyInArrow(measure, "a long, b long")
        links = durable(links.union(found))


def cell_links(cells: DataFrame, sets: DataFrame, percent: int, cap: int, pivots: int) -> DataFrame:
    """Links that join the components of all cells (``cell, doc_id, n_shingles``), whose shingles ``sets`` has by ``doc_id``."""
    parts, links, stuck = [], [], []
    cells, turn = cells.withColumn("parent", F.lit(None).cast("long")), 0
    while True:
        cells = durable(cells)
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("weight"), F.max("parent").alias("parent"))
        large = durable(sizes.where((F.col("weight") > cap) & (F.col("docs") > 1)))
        cells = cells.drop("parent")
        if large.isEmpty():
            parts.append(cells)
            break
        parts.append(cells.join(large, "cell", "left_anti"))
        whole = large.where(F.col("weight") > 0.8 * F.col("parent"))
        stuck.append((cells.join(whole, "cell", "left_semi"), whole))
        shrinks = large.join(whole, "cell", "left_anti")
        turn += 1
        cells, met = voronoi_cells(cells.join(shrinks, "cell", "left_semi").join(sets, "doc_id"), shrinks, percent, cap, pivots, turn)
        links.append(met)
    small = parts[0]
    for more in parts[1:]:
        small = small.unionByName(more)
    out = small.join(sets, "doc_id").groupBy("cell").applyInArrow(lambda t: _small(t, percent), "a long, b long").where("a <> b")
    for met in links:
        out = out.union(met)
    out = durable(out)
    for rows, sizes in stuck:
        if not sizes.isEmpty():
            out = _by_blocks(rows.join(sets, "doc_id"), sizes, out, percent, cap, pivots)
    return out


def jaccard_components(docs: DataFrame, percent: int = SIMILARITY_PERCENT, cap: int = CAP, pivots: int = PIVOTS) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``: components of Jaccard links.

    A set is the distinct five-word shingles of the lower-cased words; a shorter text is one
    shingle; a null or empty text has none and is linked with nothing.  Two documents link when
    ``100 * intersection >= percent * union``.  Documents with equal sets are one class and meet
    the others through their smallest ``doc_id``.  Rows with a null ``doc_id`` are left out.
    """
    rows = durable(rare_keys(docs, percent))
    some = rows.where(F.size("keys") > 0)
    classes = durable(some.groupBy("class").agg(F.min("doc_id").alias("rep")))
    reps = some.join(classes, (some["class"] == classes["class"]) & (F.col("doc_id") == F.col("rep"))).select("doc_id", "n_shingles", "keys", "shingles")
    # A hot shingle is dealt over salts, whose pivots then name the smallest.
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = durable(reps.select("doc_id", F.explode("keys").alias("key"), spread.alias("salt")))
    local = durable(salted.groupBy("key", "salt").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")))
    pivot = local.groupBy("key").agg(F.min("pivot").alias("cell"), F.sum("n").alias("n")).where("n > 1")
    cells = salted.join(local.select("key", "salt").join(pivot.select("key", "cell"), "key"), ["key", "salt"]).select("doc_id", "cell").distinct()
    links = cell_links(cells.join(reps.select("doc_id", "n_shingles"), "doc_id"), reps.select("doc_id", "shingles"), percent, cap, pivots)
    component = connected_components(links).withColumnRenamed("v", "rep")
    by_class = classes.join(component, "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    by_class = by_class.withColumnRenamed("class", "of_class")
    out = rows.join(by_class, (F.size("keys") > 0) & (rows["class"] == F.col("of_class")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each component, columns unchanged.

    Of rows repeated with one id and text, one stays: the smallest by its columns in order.  Rows
    with a null id are in no component and all stay.
    """
    groups = jaccard_components(docs, percent)
    name = fresh(docs.columns, "of_id")
    losers = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    kept = docs.join(losers, F.col("doc_id") == F.col(name), "left_anti")
    return without_repeats(kept)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each id and text, columns unchanged; null ids stay as they are."""
    name = fresh(docs.columns, "of_id")
    repeated = durable(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name))
    if repeated.isEmpty():
        return docs
    single = docs.join(repeated, F.col("doc_id") == F.col(name), "left_anti")
    several = docs.join(repeated, F.col("doc_id") == F.col(name), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(several.select("row.*"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
