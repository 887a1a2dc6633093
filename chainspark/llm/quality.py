"""Quality classifier by co-training two views of a document.

The text view sees hashed byte pairs and the layout of the content; the metadata view sees the
page's language, source and stated size, and nothing of the text.  Each is a logistic model fitted on a bounded sample of labelled rows.
Over several rounds each view hands the other its most confident answers on an unlabelled
pool as pseudo-labels.  Both are then calibrated on labelled rows kept aside, and the mean of
their calibrated log-odds scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import Words, documents, fresh, slices, utf8_buffers

MAX_LABELLED = 8_000
MAX_POOL = 8_000
ROUNDS = 5
PER_ROUND = 0.05
CONFIDENT = 0.98
THRESHOLD = 0.5

PAIRS = 256
_FOLD = np.random.default_rng(11).integers(0, PAIRS, 1 << 16).astype(np.int64)
FIGURES, LANGS, SOURCES = 15, 8, 32
#: Stated sizes below which a document is short, in grades.
GRADES = (20, 50, 100, 200, 400, 800, 1600)
METADATA = 3 + len(GRADES) + LANGS + SOURCES
SCORED = "doc_id long, p_text double, p_metadata double, score double, keep boolean"


def pair_shares(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs of each text."""
    raw, offsets = utf8_buffers(column)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    if len(raw) < 2:
        return np.zeros((rows, PAIRS))
    same = row[1:] == row[:-1]
    pair = _FOLD[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    counts = np.bincount((row[1:] * PAIRS + pair)[same], minlength=rows * PAIRS).reshape(rows, PAIRS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def layout(column: pa.Array) -> np.ndarray:
    """Words, lines, and shares of kinds of characters of each text."""
    raw, offsets = utf8_buffers(column)
    words = Words(column)
    size = np.diff(offsets)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    upper = letter & (raw < 97)
    n = np.diff(words.first)
    row = words.row_of()
    follows = np.zeros(len(row), bool)
    follows[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[follows], minlength=len(n))
    order = np.lexsort((words.hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    lines = count(raw == 10) + 1
    per = lambda x, of: x / np.maximum(of, 1)
    figures = [
        np.log1p(n), np.log1p(lines), n == 0, n < 5, n < 20,
        per(count(upper), count(letter)), per(count(letter), size), per(count((raw >= 48) & (raw <= 57)), size),
        per(count(raw >= 128), size), per(count(raw == 32), size), per(size, n), per(n, lines), per(repeats, n), per(distinct, n),
        per(count((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 127)), size),
    ]
    return np.column_stack(figures).astype(np.float64)


def text_view(column: pa.Array) -> np.ndarray:
    return np.hstack([pair_shares(column), layout(column)])


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """Language, source and stated size of each document; a size not stated is a figure of its own."""

    def one_hot(name: str, width: int) -> np.ndarray:
        out = np.zeros((batch.num_rows, width))
        out[np.arange(batch.num_rows), [0 if x is None else 1 + crc32(x.encode()) % (width - 1) for x in batch.column(name).to_pylist()]] = 1
        return out

    stated = batch.column("n_chars").to_pylist()
    told = np.maximum(np.array([x or 0 for x in stated], np.float64), 0)
    missing = np.array([x is None for x in stated])
    grades = [(told < top) & ~missing for top in GRADES]
    size = np.column_stack([np.log1p(told), np.log1p(told) ** 2, missing, *grades]).astype(np.float64)
    return np.hstack([size, one_hot("lang", LANGS), one_hot("source", SOURCES)])


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        keep = np.full(z.shape[1], ridge)
        keep[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = np.maximum(p * (1 - p), 1e-6) * weight
            step = np.linalg.solve((z * slope[:, None]).T @ z + np.diag(keep), z.T @ (weight * (y - p)) - keep * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return np.clip(self.slope * raw + self.shift, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows the model has not seen."""
        raw = self.odds(x)[:, None]
        if len(np.unique(y)) == 2:
            fitted = Logistic.fit(raw, y, np.ones(len(y)), ridge=1e-2)
            slope = fitted.weights[0] / fitted.scale[0]
            if slope > 0:
                self.slope, self.shift = float(slope), float(fitted.weights[1] - slope * fitted.mean[0])


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> list[Logistic]:
    """Calibrated models of the two views; every fifth labelled row is kept aside for that."""
    aside = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~aside])) < 2:
        aside[:] = False
    sets = [([v[~aside]], [y[~aside]]) for v in views]
    free = np.ones(len(pool[0]), bool)

    def fit(k: int) -> Logistic:
        target = np.concatenate(sets[k][1])
        weight = np.where(np.arange(len(target)) < len(sets[k][1][0]), 1.0, 0.3)
        return Logistic.fit(np.vstack(sets[k][0]), target, weight)

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        answers = [m.odds(p) for m, p in zip(models, pool)]
        for k in (0, 1):
            sure = np.flatnonzero(free & (probability(np.abs(answers[k])) > CONFIDENT))
            sure = sure[np.argsort(-np.abs(answers[k][sure]), kind="stable")]
            # Both classes in the proportion the view sees in the pool.
            good = answers[k][sure] > 0
            most = int(PER_ROUND * len(free)) + 1
            share = max(1, round(most * good.mean())) if len(sure) else 0
            taken = np.concatenate([sure[good][:share], sure[~good][: max(1, most - share)]])
            free[taken] = False
            sets[1 - k][0].append(pool[1 - k][taken])
            sets[1 - k][1].append((answers[k][taken] > 0).astype(float))
        models = [fit(0), fit(1)]
    for m, v in zip(models, views):
        if aside.any():
            m.calibrate(v[aside], y[aside])
    return models


def _inputs(docs: DataFrame) -> DataFrame:
    """The five columns of documents, by name; missing ones are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _views(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Both views of a bounded table, on the driver, with its last column.  Of a repeated id one row counts."""
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars", "quality")).alias("row")).select("doc_id", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                a, b = text_view(piece.column("text")), metadata_view(piece)
                raw = [x.tobytes() for x in np.hstack([a, b]).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(raw, pa.binary())], names=["doc_id", "quality", "views"])

    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, views binary").collect(), key=lambda r: (r[0] * 0x9E3779B1 % 2**32, r[0]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float64).reshape(len(got), PAIRS + FIGURES + METADATA)
    return np.array([r[1] for r in got], np.float64), [x[:, : PAIRS + FIGURES], x[:, PAIRS + FIGURES :]]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> list[Logistic] | None:
    """Models of both views, or None where the labels lack a class.

    At most ``max_labelled`` labelled and ``max_pool`` other rows are fitted, drawn by a hash of
    the id over the whole tables.  Of conflicting labels of one id the lower counts.
    """
    luck = F.xxhash64("doc_id", F.lit(3))
    given = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = given.orderBy(luck, "doc_id").limit(max_labelled)
    rows = _inputs(docs).where("doc_id is not null")
    y, views = _views(rows.join(F.broadcast(known), "doc_id"))
    if len(np.unique(y)) < 2:
        return None
    others = rows.select("doc_id").distinct().join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").orderBy(luck, "doc_id").limit(max_pool)
    _, pool = _views(rows.join(F.broadcast(others), "doc_id").withColumn("quality", F.lit(-1)))
    if not len(pool[0]):
        pool = [v[:0] for v in views]
    return co_train(views, y, pool)


def score(docs: DataFrame, models: list[Logistic] | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id, p_text, p_metadata, score, keep``; without models all stay, unscored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n = piece.num_rows
                if models:
                    odds = [m.odds(v) for m, v in zip(models, (text_view(piece.column("text")), metadata_view(piece)))]
                    both = probability((odds[0] + odds[1]) / 2)
                    out = [pa.array(probability(odds[0])), pa.array(probability(odds[1])), pa.array(both), pa.array(both >= threshold)]
                else:
                    out = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *out], names=["doc_id", "p_text", "p_metadata", "score", "keep"])

    return _inputs(docs).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (``doc_id, quality``) and score every row of ``docs``.

    Null texts count as empty; a null language, source or ``n_chars`` is a category of its own.
    Null ids and repeated rows are scored alike.  Empty documents give no rows; labels that lack
    a class leave every document kept and unscored.
    """
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those the classifier rejects, columns unchanged.

    Rows fall by id, so of rows that share an id all fall if one is rejected; rows without an id fall by
    what the classifier sees of them.
    """
    name = fresh(docs.columns, "of_id")
    models = train(docs, labels)

    def kept(rows: DataFrame, key: Column) -> DataFrame:
        rejected = score(rows.withColumn("doc_id", key), models).where("not keep").select(F.col("doc_id").alias(name))
        return rows.join(rejected, key == F.col(name), "left_anti")

    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept(docs, F.col("doc_id"))
    seen = F.xxhash64(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    return kept(docs.where("doc_id is not null"), F.col("doc_id")).unionByName(kept(nameless, seen))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
