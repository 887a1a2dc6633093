"""Shared pieces of the corpus operators: durable cuts, text kernels, keyed counting.

The text kernels work on whole Arrow string columns with numpy, so a word costs a few
vector operations and never a Python call.  A *word* is a run of bytes other than
``0x20`` and ``0x09-0x0D`` after A-Z are lower-cased; null texts count as empty.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY_PERCENT = 80

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    In local mode, where one machine runs all, a temporary folder serves; a cluster without a
    shared folder is an error, as its executors would write to different disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-cut-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text):
    """Column: A-Z lower-cased, every other character kept.  Pure ASCII takes the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


# ---------------------------------------------------------------- text kernels


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a round."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * _K1
    live, shift = np.arange(len(starts)), 0
    while len(live):
        left = size[live] - shift
        v = loads[starts[live] + shift].astype(np.uint64)
        part = left < 8
        v[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mix(out[live] + _K1 + v)
        shift += 8
        live = live[left > 8]
    return out


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands."""
    ordered = np.sort(keys)
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[heads], np.diff(np.concatenate([heads, [len(ordered)]])).astype(np.int64)


class Words:
    """Words of a string column: hash of each, and per row the index of its first word."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        raw, self.offsets = utf8_buffers(column)
        self.data = _LOWER[raw]
        solid = ~_BLANK[self.data]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(len(raw), dtype=bool)
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0], before[1:] = True, ~solid[:-1]
            after[-1], after[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = hash_spans(self.data, self.starts, self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle_hashes(word_hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter sequence is one shingle, none without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(width, n)
    out = np.full(n - size + 1, size, dtype=np.uint64) * _K3
    for j in range(size):
        out = out * _K1 + word_hashes[j : n - size + 1 + j]
    return mix(out)


def slices(table: pa.Table | pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.Table | pa.RecordBatch]:
    """Cut a batch so that each piece has about ``most`` bytes of text, a longer text alone."""
    lengths = np.diff(utf8_buffers(table.column(column))[1])
    start, held = 0, 0
    for i, size in enumerate(lengths):
        if held and held + size > most:
            yield table.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(lengths):
        yield table.slice(start)


# ------------------------------------------------------------- keyed counting

BUCKET_BYTES = 6 << 20


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(docs: DataFrame, weight: int) -> int:
    """Buckets of about ``BUCKET_BYTES`` of text, at least one a shuffle partition."""
    return max(shuffle_partitions(docs.sparkSession), -(-weight // BUCKET_BYTES))


def in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text, bucket``: documents spread evenly by a hash of id and text."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))


def key_bytes(keys: int, spare_bits: int = 18) -> int:
    """Bytes of a hash that keep a chance meeting of one key among all below ``2 ** -spare_bits``."""
    return min(8, max(5, -(-(max(keys, 1).bit_length() + spare_bits) // 8)))


def leading(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys with all but their leading bytes cleared."""
    drop = np.uint64(64 - 8 * width)
    return keys >> drop << drop


def pack(keys: np.ndarray, width: int) -> bytes:
    """The leading ``width`` bytes of sorted 64-bit keys, as steps laid out byte by byte.

    Steps between sorted keys have few leading bits, so most of their high bytes are zero and
    the shuffle's compression removes them.
    """
    steps = np.diff(keys >> np.uint64(64 - 8 * width), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    full = np.zeros((len(raw) // width, 8), np.uint8)
    full[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    steps = full.reshape(-1).view(">u8").astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(64 - 8 * width)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts up to 63 bits: as many bytes each as the largest needs, laid out byte by byte."""
    width = max(1, -(-int(counts.max()).bit_length() // 8)) if len(counts) else 1
    planes = np.ascontiguousarray(counts.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T)
    return bytes([width]) + planes.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    width = raw[0]
    full = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    full[:, 8 - width :] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return full.reshape(-1).view(">i8").astype(np.int64)


def cuts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the key space starts in sorted keys."""
    bounds = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]]).astype(np.int64)


def concat(arrays: list[np.ndarray], kind: type = np.uint64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts ``values``, starts of the runs of equal ones, and the run of each in that order."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


REQUEST = "bucket int, part int, keys array<binary>, counts array<binary>"
REPLY = "bucket int, part int, counts array<binary>, stats array<long>"
Family = tuple[np.ndarray, np.ndarray]


def count_keys(
    asking: DataFrame,
    parts: int,
    widths: tuple[int, ...] = (8,),
    stats_of: Callable[[np.ndarray, np.ndarray], list[int]] | None = None,
) -> DataFrame:
    """Corpus-wide 64-bit count of every key, sent back to each bucket that asked (``REPLY``).

    ``asking`` has the rows that ``requests`` makes.  One group sums a range of keys over all
    buckets and answers each.  Only ranges that a bucket asks travel, so there are never more
    messages than keys.  ``stats_of`` gives summable figures of the first family's keys of a range; their
    sum over all ranges comes with every reply.
    """

    def answer(table: pa.Table) -> pa.Table:
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        back: list[list[bytes]] = [[] for _ in keys]
        stats = None
        for f, width in enumerate(widths):
            asked = [unpack(k[f], width) for k in keys]
            flat, own = concat(asked), concat([unpack_counts(c[f]) for c in counts], np.int64)
            order, heads, run = grouped(flat)
            sums = np.add.reduceat(own[order], heads) if len(heads) else own
            if f == 0 and stats_of:
                stats = [int(x) for x in stats_of(flat[order][heads], sums)]
            total = np.empty(len(flat), np.int64)
            total[order] = sums[run]
            ends = np.cumsum([0, *map(len, asked)])
            for out, a, b in zip(back, ends[:-1], ends[1:]):
                out.append(pack_counts(total[a:b]))
        buckets, part = table.column("bucket").to_pylist(), table.column("part").to_pylist()
        if stats is not None:
            buckets, part, back = [*buckets, None], [*part, part[0]], [*back, None]
        said = [None] * len(buckets) if stats is None else [None] * (len(buckets) - 1) + [stats]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip((buckets, part, back, said), kinds)], names=["bucket", "part", "counts", "stats"])

    answered = asking.groupBy("part").applyInArrow(answer, REPLY)
    if stats_of is None:
        return answered
    figures = answered.where("bucket is null").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    figures = figures.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("stats")).scalar()
    return answered.where("bucket is not null").select("bucket", "part", "counts", figures.alias("stats"))


def requests(bucket: int, families: list[Family], parts: int, widths: tuple[int, ...] = (8,)) -> pa.Table:
    """A bucket's sorted distinct keys with its own counts, cut by range of the key (``REQUEST``)."""
    cuts = [cuts_of(keys, parts) for keys, _ in families]
    asked = [p for p in range(parts) if any(c[p + 1] > c[p] for c in cuts)]
    keys = [[pack(k[c[p] : c[p + 1]], w) for (k, _), c, w in zip(families, cuts, widths)] for p in asked]
    counts = [[pack_counts(n[c[p] : c[p + 1]]) for (_, n), c in zip(families, cuts)] for p in asked]
    columns = [pa.array([bucket] * len(asked), pa.int32()), pa.array(asked, pa.int32()), pa.array(keys, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.binary()))]
    return pa.table(columns, names=["bucket", "part", "keys", "counts"])


def replies(table: pa.Table, families: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """The counts for a bucket's keys of each family, in their order, and the summed statistics."""
    table = table.sort_by("part")
    counts = table.column("counts").to_pylist()
    stats = table.column("stats")[0].as_py() if table.num_rows else None
    return [concat([unpack_counts(c[f]) for c in counts], np.int64) for f in range(families)], np.array(stats or [], np.int64)


# ------------------------------------------------------------------- the sieve

CODES = "bucket int, part int, first long, codes binary"
MARKS = "bucket int, part int, n long, marks binary"
_STEP = np.uint64(65535)


def pack_codes(codes: np.ndarray) -> bytes:
    """Steps of sorted numbers in two bytes; a step of 65535 or more leads through full ones."""
    steps = np.diff(codes)
    full, rest = steps // _STEP, (steps % _STEP).astype("<u2")
    at = np.cumsum(full.astype(np.int64) + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 65535, "<u2")
    out[at] = rest
    return out.tobytes()


def unpack_codes(first: int, raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, "<u2")
    reached = np.cumsum(steps.astype(np.uint64)) + np.uint64(first)
    return np.concatenate([np.array([first], np.uint64), reached[steps != 65535]])


def shared_marks(bucketed: DataFrame, parts: int, bits: int, keys_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """For each bucket a bit for every key: may another bucket have it too (``MARKS``)?

    Keys travel cut to their leading ``bits``.  A key without a mark is the bucket's alone, so its
    count over the corpus is the bucket's own; a chance meeting only costs one request.
    """
    cut = np.uint64(64 - bits)

    def code(table: pa.Table) -> pa.Table:
        keys = keys_of(table)
        cuts = cuts_of(keys, parts)
        asked = np.flatnonzero(np.diff(cuts))
        short = [keys[cuts[p] : cuts[p + 1]] >> cut for p in asked]
        bucket = table.column("bucket")[0].as_py()
        columns = [[bucket] * len(asked), asked, [int(x[0]) for x in short], [pack_codes(x) for x in short]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "part", "first", "codes"])

    def mark(table: pa.Table) -> pa.Table:
        asked = [unpack_codes(f, c) for f, c in zip(table.column("first").to_pylist(), table.column("codes").to_pylist())]
        order, heads, run = grouped(np.concatenate(asked))
        many = np.empty(len(order), bool)
        many[order] = (np.diff(np.append(heads, len(order))) > 1)[run]
        ends = np.cumsum([0, *map(len, asked)])
        marks = [np.packbits(many[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
        columns = [table.column("bucket").cast(pa.int32()), table.column("part").cast(pa.int32()), pa.array([len(x) for x in asked], pa.int64()), pa.array(marks, pa.binary())]
        return pa.table(columns, names=["bucket", "part", "n", "marks"])

    return bucketed.groupBy("bucket").applyInArrow(code, CODES).groupBy("part").applyInArrow(mark, MARKS)


def marked(table: pa.Table) -> np.ndarray:
    """A bucket's marks, in the order of its keys."""
    table = table.sort_by("part")
    rows = zip(table.column("n").to_pylist(), table.column("marks").to_pylist())
    return concat([np.unpackbits(np.frombuffer(raw, np.uint8), count=n) for n, raw in rows], np.uint8).astype(bool)
