"""N-gram language-model scoring with a weighted backoff automaton.

States are the n-gram histories found in training, the empty history the root.  From a state, a
seen word has an arc of its own smoothed probability; any other word takes the failure arc to the
shorter history, at that arc's weight.  With Dirichlet smoothing,

    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu),

the failure arc of ``h`` weighs ``mu / (c(h) + mu)`` and each state's arcs sum to one over the
vocabulary and one unknown word, whose probability at the root is what absolute discounting
takes from the known ones.

The automaton is as large as the corpus, so it is never whole in one place: n-gram counts are
summed in ranges of their hash, and each bucket of documents gets the arcs and states that its
own texts can reach, then walks its texts left to right.  A sieve goes before the counting of
longer n-grams, most of which stand in one bucket alone and need no message.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import (
    REQUEST,
    Words,
    bucket_count,
    concat,
    count_keys,
    documents,
    grouped,
    in_buckets,
    key_bytes,
    leading,
    marked,
    mix,
    replies,
    requests,
    shared_marks,
    slices,
    text_bytes,
)

ORDER = 3
#: A weight for each history of one word or more.
MU = (2000.0, 50.0)
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x5DEECE66D1234567)
#: Tokens that a lane of the walk reads; a lane first reads the history before its own tokens.
LANE = 256
_K = np.uint64(0x9E3779B97F4A7C15)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id has an empty text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """Token hashes of a bucket: the words of each text, then one end."""

    def __init__(self, table: pa.Table):
        hashes, sizes, self.ids = [], [], []
        for piece in slices(table, "text"):
            words = Words(piece.column("text"))
            n = np.diff(words.first) + 1
            out = np.full(int(n.sum()), END, np.uint64)
            inner = np.ones(len(out), bool)
            inner[np.cumsum(n) - 1] = False
            out[inner] = words.hashes
            hashes.append(out)
            sizes.append(n)
            self.ids += piece.column("doc_id").to_pylist()
        self.hashes = concat(hashes)
        self.sizes = concat(sizes, np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.heads, self.sizes)

    def grams(self, order: int, width: int) -> list[np.ndarray]:
        """Keys of the 1- to ``order``-grams that end at each token; 0 where one would pass the start.

        The end before a text is its first history.
        """
        run, out = self.hashes, [self.hashes]
        for k in range(2, order + 1):
            last = np.empty_like(run)
            last[:1], last[1:] = END, run[:-1]
            last[self.place == 0] = END
            run = mix(last * _K + self.hashes)
            key = leading(run, width)
            key[self.place < k - 2] = 0
            out.append(key)
        return out


class Table:
    """Distinct n-grams of one length in a bucket: keys, own training counts, and each token's n-gram."""

    def __init__(self, keys: np.ndarray, train: np.ndarray):
        order, heads, run = grouped(keys)
        self.keys = keys[order[heads]]
        self.first = order[heads]
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = run
        self.counts = np.bincount(self.of[train], minlength=len(heads)).astype(np.int64)


def _tables(tokens: Tokens, order: int, width: int) -> list[Table]:
    return [Table(keys, tokens.train) for keys in tokens.grams(order, width)]


def _long(tables: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of two words and more, sorted, and where each stands in the tables in line."""
    keys = concat([t.keys for t in tables[1:]])
    order = np.argsort(keys, kind="stable")
    order = order[np.searchsorted(keys[order], 1) :]
    return keys[order], order


def _figures(keys: np.ndarray, sums: np.ndarray) -> list[int]:
    """Training tokens, types, and types seen once and twice."""
    return [sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum()]


class Automaton:
    """The part of the automaton that a bucket's texts can reach.

    State 0 is the root; then come the seen histories of one word, of two, and so on.
    ``arcs[k]`` has, for each token, the arc that a state of ``k`` words has for it, or -1.
    """

    def __init__(self, tables: list[Table], tokens: Tokens, figures: np.ndarray, mu: tuple[float, ...]):
        self.total, self.types, once, twice = (int(x) for x in figures) if len(figures) else (0, 0, 0, 0)
        discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        unknown = discount * self.types / self.total if self.total else 1.0
        self.unknown = np.log10(unknown)
        self.known = tables[0].counts[tables[0].of]
        longest = len(mu)
        counts = [t.counts for t in tables]
        seen = [c > 0 for c in counts]
        ends = int(np.searchsorted(tables[0].keys, END))
        chance = [np.where(seen[0], (counts[0] - discount) / max(self.total, 1), unknown)]
        self.fail, weight, base = [np.zeros(1, np.int64)], [np.ones(1)], [0, 1]
        for k in range(1, longest + 1):
            # States of k words, which fail to their last k - 1 and whose arcs are seen (k + 1)-grams.
            history, arcs = tables[k - 1], tables[k]
            shorter = np.zeros(len(history.keys), np.int64) if k == 1 else base[k - 1] + tables[k - 2].of[history.first]
            self.fail.append(shorter)
            weight.append(mu[k - 1] / (history.counts + mu[k - 1]))
            base.append(base[k] + len(history.keys))
            before = np.where(tokens.place[arcs.first] > 0, history.of[np.maximum(arcs.first - 1, 0)], ends if k == 1 else 0)
            below = chance[k - 1][history.of[arcs.first]]
            chance.append((counts[k] + mu[k - 1] * below) / (history.counts[before] + mu[k - 1]))
        self.fail, self.weight = np.concatenate(self.fail), np.log10(np.concatenate(weight))
        self.words_in = np.repeat(np.arange(longest + 1), np.diff(base))
        self.arcs = [np.where(s[t.of], t.of, -1) for s, t in zip(seen, tables)]
        if longest:
            # An n-gram that would pass the start of its text has no arc.
            for k in range(2, longest + 1):
                self.arcs[k][tokens.place < k - 1] = -1
        self.arc_log = [np.log10(c) for c in chance]
        # Where each arc leads: the longest state that ends with its word.
        self.target = [base[min(k + 1, longest)] + self.state_of(tables, k, longest) for k in range(longest + 1)]
        self.start = base[1] + ends if longest and seen[0][ends : ends + 1].any() else 0

    @staticmethod
    def state_of(tables: list[Table], k: int, longest: int) -> np.ndarray:
        if not longest:
            return np.zeros(len(tables[0].keys), np.int64)
        kept = min(k + 1, longest)
        return tables[kept - 1].of[tables[k].first]

    def walk(self, tokens: Tokens) -> np.ndarray:
        """Log10 probability of each token, read left to right with the state carried along.

        Texts are read in lanes side by side.  A lane that starts within a text first reads the
        words of the longest history before it, after which its state is the text's own.
        """
        longest = len(self.arcs) - 1
        lanes = -(-tokens.sizes // LANE)
        offset = (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        begin, end = np.repeat(tokens.heads, lanes) + offset, np.repeat(tokens.heads + tokens.sizes, lanes)
        end = np.minimum(begin + LANE, end)
        lead = np.where(offset > 0, longest, 0)
        order = np.argsort(begin - lead - end, kind="stable")  # the longest lane first
        begin, end, lead = begin[order], end[order], lead[order]
        at = begin - lead
        state = np.where(lead > 0, 0, self.start)
        out = np.zeros(len(tokens.hashes))
        left = np.searchsorted(at - end, -np.arange(LANE + longest + 1))
        for step in range(int((end - at).max(initial=0))):
            n = int(left[step])
            token, here = at[:n] + step, state[:n]
            score, waiting = np.zeros(n), np.ones(n, bool)
            for k in range(longest, -1, -1):
                arc = self.arcs[k][token]
                on = waiting & (self.words_in[here] == k)
                hit = on & (arc >= 0)
                score[hit] += self.arc_log[k][arc[hit]]
                if k:
                    miss = on & (arc < 0)
                    score[miss] += self.weight[here[miss]]
                    moved = np.where(hit, self.target[k][arc], np.where(miss, self.fail[here], here))
                else:
                    miss = on & (arc < 0)
                    score[miss] += self.unknown
                    moved = np.where(hit, self.target[0][arc], np.where(miss, 0, here))
                waiting &= ~hit
                here = moved
            state[:n] = here
            own = step >= lead[:n]
            out[token[own]] = score[own]
        return out


def score_documents(docs: DataFrame, order: int = ORDER, mu: tuple[float, ...] = MU) -> DataFrame:
    """Train on the documents not held out and score all.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  Tokens are
    lower-cased words and one end a text; a null or empty text is one end.  Repeated rows count
    as often as they stand.  Without training tokens every score is 0; an empty table gives none.
    """
    mu = tuple(mu[: order - 1])
    weight = text_bytes(docs)
    buckets = bucket_count(docs, weight)
    grams = weight // 6 * max(order - 1, 1) + 1
    width, bits = key_bytes(grams), min(60, grams.bit_length() + 5)
    bucketed = in_buckets(docs.withColumn("doc_id", docs["doc_id"].cast("long")), buckets)
    marks = shared_marks(bucketed, buckets, bits, lambda table: _long(_tables(Tokens(table), order, width))[0])

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tables = _tables(Tokens(texts), order, width)
        keys, line = _long(tables)
        shared = marked(answers)
        counts = concat([t.counts for t in tables[1:]], np.int64)[line]
        families = [(tables[0].keys, tables[0].counts), (keys[shared], counts[shared])]
        return requests(texts.column("bucket")[0].as_py(), families, buckets, (8, width))

    asking = bucketed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(ask, REQUEST)
    counted = count_keys(asking, buckets, (8, width), _figures)
    none = lambda *kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    told = counted.select("bucket", "part", "counts", "stats", *none(("n", "long"), ("marks", "binary")))
    told = told.unionByName(marks.select("bucket", "part", *none(("counts", "array<binary>"), ("stats", "array<long>")), "n", "marks"))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(texts)
        tables = _tables(tokens, order, width)
        is_mark = pc.is_valid(answers.column("marks"))
        (words, longer), figures = replies(answers.filter(pc.invert(is_mark)), 2)
        keys, line = _long(tables)
        shared = line[marked(answers.filter(is_mark))]
        tables[0].counts = words
        flat = concat([t.counts for t in tables[1:]], np.int64)
        flat[shared] = longer
        for t, a in zip(tables[1:], np.cumsum([0, *(len(t.keys) for t in tables[1:])])):
            t.counts = flat[a : a + len(t.keys)]
        automaton = Automaton(tables, tokens, figures, mu)
        steps = automaton.walk(tokens) if automaton.total else np.zeros(len(tokens.hashes))
        known = automaton.known
        base = np.log10((known + 1) / (automaton.total + automaton.types + 1))
        per = lambda x: np.add.reduceat(x, tokens.heads) if len(x) else x
        return pa.table(
            {
                "doc_id": pa.array(tokens.ids, pa.int64()),
                "held_out": pa.array(tokens.held),
                "n_tokens": pa.array(tokens.sizes, pa.int64()),
                "n_known": pa.array(per((known > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([automaton.total] * len(tokens.ids), pa.int64()),
                "base_score": pa.array(per(base), pa.float64()),
                "score": pa.array(per(steps), pa.float64()),
            }
        )

    return bucketed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, SCORED)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
