"""Repeated passages by a sparse suffix index at minimisers.

Of the 41 ten-word runs of a 50-word window the smallest hash, at its first place, is the window's
anchor, so equal windows have equal anchors.  Windows whose anchor stands in one document alone are
put aside by an exact count.  For the others the whole window (what stands before the anchor, the
anchor and what follows) is hashed, and the two smallest documents that hold each window are found
over the corpus; a window with two is repeated.  All windows around an anchor are counted, however
its match is split over both sides, and a passage shared by very many documents costs one entry a
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import REQUEST, Words, bucket_count, count_keys, cuts_of, distinct_counts, documents, mix, pack, replies, requests, shingle_hashes, slices, text_bytes, unpack

MIN_WORDS = 50
RUN = 10
HELD = "bucket int, part int, keys binary, low binary, step binary"
SPAN = "doc_id long, start_word long, end_word long, n_words long, other_doc_id long"
_K = np.uint64(0x9E3779B97F4A7C15)


def anchors_of(runs: np.ndarray, window: int) -> np.ndarray:
    """Hash of the smallest run of each window, mixed again so that it is spread evenly."""
    if len(runs) < window:
        return runs[:0]
    least, size = runs, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return mix(np.minimum(least[: len(runs) - window + 1], least[window - size :]))


def windows_of(runs: np.ndarray, min_words: int, run: int) -> np.ndarray:
    """Hash of each window of ``min_words`` words, from the runs that cover it."""
    n = len(runs) - (min_words - run)
    if n <= 0:
        return runs[:0]
    out = np.zeros(n, np.uint64)
    for k in [*range(0, min_words - run, run), min_words - run]:
        x = out * _K + runs[k : k + n]
        out = x ^ (x >> np.uint64(32))
    return out


def _rows(table: pa.Table, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per row: its document, and the anchor and hash of each of its windows."""
    run = min(RUN, min_words)
    for piece in slices(table, "text"):
        words = Words(piece.column("text"))
        for i, a, b in zip(piece.column("doc_id").to_pylist(), words.first[:-1], words.first[1:]):
            if b - a >= min_words:
                runs = shingle_hashes(words.hashes[a:b], run)
                yield i, anchors_of(runs, min_words - run + 1), windows_of(runs, min_words, run)


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _anchors(table: pa.Table, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a bucket and in how many of its documents each stands."""
    own: dict[int, list[np.ndarray]] = {}
    for i, anchors, _ in _rows(table, min_words):
        own.setdefault(i, []).append(np.unique(anchors))
    return distinct_counts(_joined([x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in own.values()], np.uint64))


def _two_least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the smallest document of each, and the step to the next (0: none)."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(head)
    many = np.zeros(len(at), bool)
    many[:-1] = ~head[at[:-1] + 1]
    many[-1:] = at[-1:] + 1 < len(keys)
    step = np.zeros(len(at), np.uint64)
    step[many] = docs[at[many] + 1].view(np.uint64) - docs[at[many]].view(np.uint64)
    return keys[at], docs[at], step


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, so that the shuffle's compression removes the high bytes."""
    return np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.dtype(kind).newbyteorder(">")).astype(kind)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, low, step = (table.column(c).to_pylist() for c in ("keys", "low", "step"))
    return _joined([unpack(x, 8) for x in keys], np.uint64), _joined([_from_planes(x, np.int64) for x in low], np.int64), _joined([_from_planes(x, np.uint64) for x in step], np.uint64)


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [[r[0] for r in rows], [r[1] for r in rows], [pack(r[2], 8) for r in rows], [_planes(r[3]) for r in rows], [_planes(r[4]) for r in rows]]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "part", "keys", "low", "step"])


def _ask(table: pa.Table, answers: pa.Table, min_words: int, parts: int) -> pa.Table:
    """Windows of a bucket whose anchor stands in several documents, by range of their hash."""
    if not table.num_rows:
        return _packed([])
    anchors, _ = _anchors(table, min_words)
    (counts,), _ = replies(answers)
    again = anchors[counts > 1]
    keys, docs = [], []
    for i, own, windows in _rows(table, min_words):
        at = np.searchsorted(again, own)
        held = np.unique(windows[(at < len(again)) & (again[np.minimum(at, len(again) - 1)] == own)]) if len(again) else windows[:0]
        keys.append(held)
        docs.append(np.full(len(held), i, np.int64))
    key, low, step = _two_least(_joined(keys, np.uint64), _joined(docs, np.int64))
    cuts = cuts_of(key, parts)
    bucket = table.column("bucket")[0].as_py()
    return _packed([(bucket, p, key[a:b], low[a:b], step[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])


def _answer(table: pa.Table) -> pa.Table:
    """To each bucket those of its keys that several documents hold, with the two smallest."""
    asked = [(b, p, *_unpacked(table.slice(i, 1))) for i, (b, p) in enumerate(zip(table.column("bucket").to_pylist(), table.column("part").to_pylist()))]
    key = np.concatenate([a[2] for a in asked])
    low = np.concatenate([a[3] for a in asked])
    step = np.concatenate([a[4] for a in asked])
    next_ = (low.view(np.uint64) + step).view(np.int64)[step > 0]
    keys, low, step = _two_least(np.concatenate([key, key[step > 0]]), np.concatenate([low, next_]))
    keys, low, step = keys[step > 0], low[step > 0], step[step > 0]
    out = []
    for bucket, part, own, _, _ in asked:
        at = np.searchsorted(keys, own)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own)] if len(keys) else at[:0]
        if len(at):
            out.append((bucket, part, keys[at], low[at], step[at]))
    return _packed(out)


def _spans(table: pa.Table, answers: pa.Table, min_words: int) -> pa.Table:
    """Unions of the repeated windows of each document of a bucket."""
    keys, low, step = _unpacked(answers)
    order = np.argsort(keys)
    keys, low, step = keys[order], low[order], step[order]
    found: dict[int, list[np.ndarray]] = {}
    for i, _, windows in _rows(table, min_words) if len(keys) else ():
        at = np.searchsorted(keys, windows)
        start = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == windows))
        if len(start):
            at = at[start]
            other = np.where(low[at] == i, (low[at].view(np.uint64) + step[at]).view(np.int64), low[at])
            found.setdefault(i, []).append(np.stack([start, other]))
    out: list[np.ndarray] = []
    for i, parts in found.items():
        start, other = np.concatenate(parts, axis=1)
        if len(parts) > 1:
            order = np.argsort(start, kind="stable")
            start, other = start[order], other[order]
        heads = np.flatnonzero(np.concatenate([[True], start[1:] > start[:-1] + min_words]))
        last = np.concatenate([heads[1:], [len(start)]]) - 1
        first, end = start[heads], start[last] + min_words
        out.append(np.stack([np.full(len(heads), i), first, end, end - first, np.minimum.reduceat(other, heads)]))
    rows = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    return pa.table([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start_word", "end_word", "n_words", "other_doc_id"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, other_doc_id``: passages found in another document.

    Words are lower-cased; spans are maximal unions of matches of at least ``min_words``; the
    other document is the smallest that shares ``min_words`` words of the span.  A passage repeated
    within one document alone is not reported, nor are null ids, null or short texts.  Repeated rows
    of one id are the same document.  An empty table gives no rows.
    """
    parts = bucket_count(docs, text_bytes(docs))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # By id alone: the rows of one document share a bucket, and a bucket's documents are its own.
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    asking = bucketed.groupBy("bucket").applyInArrow(lambda t: requests(t.column("bucket")[0].as_py(), [_anchors(t, min_words)], parts), REQUEST)
    counted = count_keys(asking, parts)
    asked = bucketed.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(lambda t, a: _ask(t, a, min_words, parts), HELD)
    answered = asked.groupBy("part").applyInArrow(_answer, HELD)
    return bucketed.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(lambda t, a: _spans(t, a, min_words), SPAN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
