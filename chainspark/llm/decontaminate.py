"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

A document is read in windows the size of each benchmark item, at every position.  A window must
hold four fifths of its shingles from the benchmark to reach a similarity of 0.8, so others are
passed over by counting alone; the rest get a 64-bit fingerprint from running sums of their shingles' votes.
Fingerprints are looked up in an index of eight 8-bit blocks: two fingerprints within ``RADIUS``
agree in some block up to ``RADIUS // 8`` bits, so looking up all such neighbours of every block
finds every item within the radius, whatever the item.  Survivors are compared exactly.

Items stay in bounded blocks (``BLOCK_CHARS`` of text each) that meet all documents in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import SHINGLE, SIMILARITY_PERCENT, Words, distinct_counts, documents, fresh, shingle_hashes, slices

RADIUS = 18
BLOCKS = 8
BLOCK_CHARS = 4_000_000
STRETCH = 1 << 16
#: Fingerprints asked times fingerprints held that one step of a look-up compares.
CELLS = 1 << 20
FOUND = "doc_id long, item_id long, start_word long, end_word long, similarity double"

_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def simhash(shingles: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of shingles (``heads`` are the runs' starts, none empty).

    Every occurrence votes, so a shingle weighs as often as it stands in the run.
    """
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    votes = np.add.reduceat(bits, heads, axis=0)
    size = np.diff(np.concatenate([heads, [len(shingles)]]))[:, None]
    return np.packbits(2 * votes > size, axis=1)


class HammingIndex:
    """Fingerprints (rows of 8 bytes), found from any fingerprints within the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.words = np.ascontiguousarray(prints).view(np.uint64).ravel()
        values = np.arange(256, dtype=np.uint8)
        # Which prints are near in a block, for each of its values.
        self.near = [_BITS[values[:, None] ^ prints[None, :, b]] <= radius // BLOCKS for b in range(BLOCKS)]

    def _within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = self.near[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            some |= self.near[b][prints[:, b]]
        at, item = np.nonzero(some)
        close = np.bitwise_count(self.words[item] ^ prints.view(np.uint64).ravel()[at]) <= self.radius
        return at[close], item[close]

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``prints``, row of the index) within the radius, in order of both.

        At most ``CELLS`` comparisons are made at a time; beyond that, equal fingerprints (windows a word
        apart often have one) are asked once.
        """
        prints = np.ascontiguousarray(prints)
        if len(prints) * len(self.prints) <= CELLS:
            return self._within(prints)
        _, first, of = np.unique(prints.view(np.uint64).ravel(), return_index=True, return_inverse=True)
        once, step = prints[first], max(1, CELLS // len(self.prints))
        starts = range(0, len(once), step)
        found = [self._within(once[start : start + step]) for start in starts]
        asker = np.concatenate([start + at for start, (at, _) in zip(starts, found)])
        item = np.concatenate([i for _, i in found])
        each = np.bincount(asker, minlength=len(once))
        # Every row takes what its fingerprint found.
        begin, count = (np.cumsum(each) - each)[of], each[of]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.arange(len(prints)), count), item[np.repeat(begin, count) + inside]


def votes_of(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the votes of shingles on each of the 64 bits, from zero."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def row_shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows in line, and where each row's start; a row of under five words has one."""
    n = np.diff(words.first)
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    if len(words.hashes) >= SHINGLE:
        whole = shingle_hashes(words.hashes)
        inside = np.arange(len(whole)) + SHINGLE <= words.first[1:][np.searchsorted(words.first[1:], np.arange(len(whole)), side="right")]
        out[np.repeat(n >= SHINGLE, sizes)] = whole[inside]
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        out[ends[r] - 1] = shingle_hashes(words.hashes[words.first[r] : words.first[r + 1]])[0]
    return out, np.concatenate([[0], ends]).astype(np.int64)


class Items:
    """One block of benchmark items, ready to meet texts."""

    def __init__(self, ids: list[int], texts: list[str], radius: int):
        words = Words(pa.array(texts, pa.string()))
        runs = [(i, words.hashes[a:b]) for i, a, b in zip(ids, words.first[:-1], words.first[1:]) if b > a]
        self.ids = [i for i, _ in runs]
        shingles = [shingle_hashes(w) for _, w in runs]
        self.sizes = sorted({len(s) for s in shingles})
        self.bags = [distinct_counts(s) for s in shingles]
        self.totals = np.array([len(s) for s in shingles], np.int64)
        flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        heads = np.cumsum([0, *map(len, shingles)])[:-1].astype(np.int64)
        prints = simhash(flat, heads) if shingles else np.zeros((0, 8), np.uint8)
        # Windows of a size meet the items of that size.
        self.of_size = {m: np.flatnonzero(self.totals == m) for m in self.sizes}
        self.index = {m: HammingIndex(prints[of], radius) for m, of in self.of_size.items()}
        self.known = np.unique(flat)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def of_benchmark(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles stand in any item."""
        out = self.gate[(shingles >> np.uint64(48)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        out[maybe] = self.known[at] == shingles[maybe]
        return out

    def windows(self, held: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
        """Row, start, end and item size of the windows of every size that hold enough benchmark shingles.

        A row shorter than an item is one window.
        """
        total = np.concatenate([[0], np.cumsum(held)])
        inside, length = np.diff(total[first]), np.diff(first)
        out = [np.zeros((4, 0), np.int64)]
        for size in self.sizes:
            some = np.flatnonzero((inside > 0) & (100 * inside >= percent * size))
            whole = some[length[some] <= size]
            begin, end, row = first[whole], first[whole + 1], whole
            longer = some[length[some] > size]
            lanes = length[longer] - size + 1
            starts = np.repeat(first[longer] - np.cumsum(lanes) + lanes, lanes) + np.arange(lanes.sum())
            begin, row = np.concatenate([begin, starts]), np.concatenate([row, np.repeat(longer, lanes)])
            end = np.concatenate([end, starts + size])
            enough = 100 * (total[end] - total[begin]) >= percent * np.maximum(size, end - begin)
            out.append(np.stack([row[enough], begin[enough], end[enough], np.full(int(enough.sum()), size)]))
        found = np.concatenate(out, axis=1)
        return found[:, np.lexsort(found[::-1])]

    def similarity(self, window: tuple[np.ndarray, np.ndarray], size: int, item: int) -> tuple[int, int]:
        """Shared and united occurrences of a window's and an item's shingles."""
        (keys, counts), (other, others) = window, self.bags[item]
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        common = int(np.where(keys[at] == other, np.minimum(counts[at], others), 0).sum())
        return common, size + int(self.totals[item]) - common

    def meet(self, column: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int, float]]:
        """``row, item_id, start, end, similarity`` of the best window of each row and item."""
        if not self.ids:
            return
        words = Words(column)
        shingles, first = row_shingles(words)
        if not len(shingles):
            return
        held = self.of_benchmark(shingles)
        if not held.any():
            return
        row, begin, end, size = self.windows(held, first, percent)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        # Running sums are made for windows that hang together, a bounded stretch at a time.
        far = np.maximum.accumulate(end)
        apart = (row[1:] != row[:-1]) | (begin[1:] >= far[:-1]) | (begin[1:] // STRETCH != begin[:-1] // STRETCH)
        heads = np.flatnonzero(np.concatenate([[True], apart])) if len(row) else row
        for a, b in zip(heads, [*heads[1:], len(row)]):
            r, base = int(row[a]), int(begin[a])
            own = shingles[base : int(end[a:b].max())]
            votes = votes_of(own)
            begins, ends = begin[a:b] - base, end[a:b] - base
            prints = np.packbits(2 * (votes[ends] - votes[begins]) > (ends - begins)[:, None], axis=1)
            base -= int(first[r])
            for m in np.unique(size[a:b]).tolist():
                of = np.flatnonzero(size[a:b] == m)
                at, item = self.index[m].find(prints[of])
                for w, j in zip(of[at].tolist(), self.of_size[m][item].tolist()):
                    x, y = int(begins[w]), int(ends[w])
                    common, union = self.similarity(distinct_counts(own[x:y]), y - x, j)
                    if 100 * common >= percent * union:
                        here = (common / union, -x - base, -y - base)
                        if here > best.get((r, j), (0.0, 0, 0)):
                            best[r, j] = here
        n = np.diff(words.first)
        for (r, j), (similarity, x, y) in sorted(best.items()):
            yield r, self.ids[j], -x, min(-y + SHINGLE - 1, int(n[r])), similarity


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = SIMILARITY_PERCENT, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, similarity``: best window of each leaked item.

    Similarity is the weighted Jaccard (shared over united occurrences) of the five-word shingles
    of item and window.  An item or text under five words is one shingle, so such an item is found
    only as a whole text.  Null or empty items and texts match nothing; rows repeated are reported
    alike; empty tables give no rows.  Ties go to the first window.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    spark, found = docs.sparkSession, []

    def run(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, rows = piece.column("doc_id").to_pylist(), list(items.meet(piece.column("text"), percent))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                cols[0] = [ids[r] for r in cols[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start_word", "end_word", "similarity"])

    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Items([r[0] for r in held], [r[1] for r in held], radius))
        found.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches, sent=sent: run(sent.value, batches), FOUND))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item, columns unchanged.

    Rows fall by id, so of rows that share an id all fall if one leaks; rows without an id fall by their text.
    """
    name = fresh(docs.columns, "of_id")

    def kept(rows: DataFrame, key: Column) -> DataFrame:
        leaked = find_leaks(rows.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
        return rows.join(leaked, key == F.col(name), "left_anti")

    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept(docs, F.col("doc_id"))
    return kept(docs.where("doc_id is not null"), F.col("doc_id")).unionByName(kept(nameless, F.xxhash64("text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
