"""Spelling variants: words one error apart, found by a bit-sliced position index.

The index keeps a bitset over its words for every (position, letter).  A query reads its letters
once; three sets of words move along: those without an error so far, and those with one (a letter
replaced; a letter too many, seen one position back; a letter too few, seen one position ahead).

Two words one error apart are equal in their first or their second half, so words meet only in
bins of a shared half, and a bin never holds more than its block of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import ascii_lower, documents, durable, shuffle_partitions

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
DROP_ONE_IN = 199
BLOCK = 1536
LETTERS_A_WEIGHT = 64
NEAR = "word string, near string, near_n long"


class PositionIndex:
    """Bitsets over ``words`` by position and letter, and by length."""

    def __init__(self, words: list[str]):
        letters, sizes, first = code_points(words)
        at = np.repeat(np.arange(len(words)), sizes)
        places = np.arange(len(letters)) - np.repeat(first, sizes)
        self.width = -(-len(words) // 64)
        self.keys, row = np.unique(places << 21 | letters, return_inverse=True)
        self.bits = self._sets(row, at, len(self.keys) + 1)
        self.sizes, row = np.unique(sizes, return_inverse=True)
        self.of_size = self._sets(row, np.arange(len(words)), len(self.sizes) + 1)

    def _sets(self, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.width), np.uint64)
        np.bitwise_or.at(out, (rows, words >> 6), np.uint64(1) << (words & 63).astype(np.uint64))
        return out

    def _at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """Words with the letter there; the last row is the empty set."""
        want = place << 21 | letters
        row = np.searchsorted(self.keys, want)
        found = (place >= 0) & (self.keys[np.minimum(row, len(self.keys) - 1)] == want)
        return self.bits[np.where(found, row, len(self.keys))]

    def _long(self, size: int) -> np.ndarray:
        row = np.searchsorted(self.sizes, size)
        return self.of_size[row if row < len(self.sizes) and self.sizes[row] == size else len(self.sizes)]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``queries``, word) one error apart; ``queries`` is a matrix of letters, all of one length."""
        n, size = queries.shape
        none = np.zeros((n, self.width), np.uint64)
        exact, swapped, longer, shorter = ~none, none, none, none
        for i in range(size):
            here, back, ahead = (self._at(i + step, queries[:, i]) for step in (0, -1, 1))
            swapped = swapped & here | exact & ~here
            longer = longer & back | exact
            shorter = (shorter | exact) & ahead
            exact = exact & here
        out = swapped & self._long(size) | longer & self._long(size - 1) | (shorter | exact) & self._long(size + 1)
        query, slot = np.nonzero(out)
        which, bit = np.nonzero(np.unpackbits(out[query, slot].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[which], slot[which] * 64 + bit


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words one after the other, each word's length and first letter."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return letters, sizes, np.cumsum(sizes) - sizes


def occurrences(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each run of letters stands in ``docs``, one code point taken out of one run in 199.

    The run's number is the CRC-32 of ``<doc_id>:<run>``, with nothing before the colon where the id is null.
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    number = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return number.select(F.when(F.col("h") % DROP_ONE_IN == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """``word, n, least, head, half``: the halves by which a word meets those of its own length and those one letter longer or shorter.

    ``least`` is the length of the shorter word of a pair.  An error behind its middle leaves the
    first half of both equal, any other the second.
    """
    size = F.length("word")
    least = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= 1)).alias("least")
    meets = words.select("word", "n", least).withColumn("middle", F.floor(F.col("least") / 2).cast("int"))
    part = F.struct(F.lit(True).alias("head"), F.substring("word", F.lit(1), F.col("middle")).alias("half"))
    rest = F.col("least") - F.col("middle")
    tail = F.struct(F.lit(False).alias("head"), F.substring("word", F.length("word") - rest + 1, rest).alias("half"))
    return meets.select("word", "n", "least", F.inline(F.array(part, tail)))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n`` of all words one error apart, each pair once in each direction.

    Small groups of a shared half are dealt into bins of about ``block`` words.  A larger group is
    indexed in blocks, each in its own bin, and its words ask all of them: that work grows with the
    square of the group, 64 words a step.  A long word weighs as many as it has times 64 letters.
    """
    parts = durable(halves(words))
    weight = F.greatest(F.lit(1), F.ceil(F.length("word") / LETTERS_A_WEIGHT))
    groups = parts.groupBy("least", "head", "half").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("members")).where("members > 1")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    bins = max(shuffle_partitions(words.sparkSession), -(-total // block))
    groups = groups.withColumn("blocks", F.ceil(F.col("weight") / block).cast("int"))
    joined = parts.join(groups.select("least", "head", "half", "blocks"), ["least", "head", "half"])
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    asks = joined.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    home = F.pmod(F.xxhash64("least", "head", "half", "block"), F.lit(bins)).alias("bin")
    dealt = asks.select(home, "word", "n", "least", "head", "half", (F.col("own") == F.col("block")).alias("held"), "block")
    return dealt.groupBy("bin").applyInArrow(meet, NEAR)


def meet(table: pa.Table) -> pa.Table:
    """Pairs of one bin, as words that share the half which is theirs to report."""
    words = table.column("word").to_pylist()
    group = group_numbers(table)
    least, head = table.column("least").to_numpy(), table.column("head").to_numpy()
    held = np.flatnonzero(table.column("held").to_numpy())
    if not len(held):
        return table.select(["word", "word", "n"]).slice(0, 0).rename_columns(["word", "near", "near_n"])
    letters, sizes, first = code_points(words)
    index = PositionIndex([words[i] for i in held])
    ask, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            q, w = index.near(letters[first[part][:, None] + np.arange(size)])
            ask.append(part[q])
            near.append(held[w])
    a, b = np.concatenate(ask), np.concatenate(near)
    keep = (group[a] == group[b]) & (np.minimum(sizes[a], sizes[b]) == least[a])
    a, b = a[keep], b[keep]
    # Pairs equal in both halves' keys belong to the first half.
    alone = [head[i] or words[i][: least[i] // 2] != words[j][: least[i] // 2] for i, j in zip(a, b)]
    a, b = a[np.array(alone, bool)], b[np.array(alone, bool)]
    return pa.table({"word": table.column("word").take(a), "near": table.column("word").take(b), "near_n": table.column("n").take(b)})


def group_numbers(table: pa.Table) -> np.ndarray:
    """A number for each shared half (and block) in a bin."""
    columns = ["least", "head", "half", "block"]
    keys = list(zip(*(table.column(c).to_pylist() for c in columns)))
    known: dict[tuple, int] = {}
    return np.fromiter((known.setdefault(k, len(known)) for k in keys), np.int64, len(keys))


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of ``docs``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away; ``form`` is the
    most frequent of them (ties: the smallest) if it stands at least ``ratio`` times as often, and
    ``root`` is where forms lead.  Null and empty texts hold no words; a null id counts as an empty one
    in the run's number; repeated rows count again; an empty table gives no rows.
    """
    words = durable(occurrences(docs).where((F.length("word") >= min_letters) & (F.col("n") >= min_count)))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    both = words.join(near, "word", "left")
    most = -F.col("best.less")
    led = most >= ratio * F.col("n")
    table = durable(both.select("word", F.when(led, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, most).alias("form_n")))
    roots = ends(table.where("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def ends(steps: DataFrame) -> DataFrame:
    """``word, root``: where each word's steps lead.  Every round doubles the reach; counts grow along steps, so they end."""
    steps = durable(steps)
    while True:
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = steps.join(beyond, "root", "left")
        moved = durable(further.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
