"""Token counts of byte-level BPE models, huge documents cut into overlapping chunks.

The model splits a text at its special strings and then, by a pattern without look-behind, into
pieces that never cross the border of a *stretch*: one optional space and the characters up to
the next white space, or a run of white space (without its last character where a character
follows).  Two scans of a text that share one border therefore agree from there on, wherever they
began.  A chunk of a huge document is read from its start to some way into its neighbour, and the
two are spliced at the first border both have: what the left scan counts before it, less what the
right scan counts before it, is the seam's share, and the shares add up to the whole count.  A
border is taken only where nothing behind a chunk's end can move it (``Stretches.trusted``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainspark.llm.common import documents, durable

CHUNK = 16384
OVERLAP = 512
GROWTH = 8
TOKEN_LIMIT = 1024
MEMO = 400_000
MEMO_WORD = 64

# The characters that the model's pattern takes for white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
COUNTED = "doc_id long, n_bytes long, n_tokens long"
PIECES = "digest string, no int, start long, last boolean, at_end boolean, value string"
SCANNED = "digest string, no int, last boolean, n long, near struct<at:long,n:long>, head map<long,long>, tail map<long,long>"
SEAM = "digest string, first int, next int, at long, n long, start long, share long"


class Stretches:
    """One model in one worker: stretches of a text and the number of tokens of each."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.special = special_strings(spec)
        self.reach = max(map(len, self.special), default=0) + 1
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.pattern = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.memo: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if not self.cut or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def learn(self, stretches: set[str]) -> dict[str, int]:
        """Token counts of stretches; the short ones are remembered."""
        new = [s for s in stretches if s not in self.memo]
        sizes = dict(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))
        if len(self.memo) + len(new) > MEMO:
            self.memo = {s: n for s in stretches if (n := self.memo.get(s)) is not None}
        self.memo.update((s, n) for s, n in sizes.items() if len(s) <= MEMO_WORD)
        return sizes

    def count_all(self, texts: list[str]) -> list[int]:
        found = [self.split(t) for t in texts]
        more = self.learn(set().union(*found))
        if all(len(s) <= MEMO_WORD for s in more):
            return [sum(map(self.memo.__getitem__, f)) for f in found]
        return [sum(self.memo[s] if s in self.memo else more[s] for s in f) for f in found]

    def borders(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Every border from 0 to the text's end, and the tokens before each."""
        found = self.split(text)
        sizes = self.learn(set(found))
        each = np.fromiter((self.memo[s] if s in self.memo else sizes[s] for s in found), np.int64, len(found))
        return np.cumsum([0, *map(len, found)]), np.concatenate([[0], np.cumsum(each)])

    def trusted(self, text: str, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Borders that no text behind the end can move.

        A special string that begins before the end and reaches over it starts at most its
        length less one before the end, and can move the border of white space one before that.
        """
        at, n = self.borders(text)
        keep = at <= (len(text) if at_end else len(text) - self.reach)
        return at[keep], n[keep]


def special_strings(spec: str) -> list[str]:
    """Special strings of a model file; an error where the splicing rule is not proven for the model."""
    model = json.loads(spec)
    pre, added = model["pre_tokenizer"] or {}, model["added_tokens"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    overlap = any(a[-k:] == b[:k] for a in (t["content"] for t in added) for b in (t["content"] for t in added) for k in range(1, min(len(a), len(b))))
    if not plain or model["normalizer"] or model["model"]["type"] != "BPE" or odd or overlap:
        raise ValueError("token counts need a byte-level BPE model without normaliser, prefix space and special strings that strip or overlap")
    return [t["content"] for t in added]


def count_tokens(docs: DataFrame, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens.  Special strings inside a text are one token
    each, nothing is added.  Null and repeated ids keep their rows; equal texts have equal counts; an
    empty table gives no rows; other columns are not read.  Texts of more than ``chunk`` characters
    are known by their SHA-256, cut once for all copies, and counted by chunk wherever Spark puts them.
    The model file travels with the tasks (its size is fixed).
    """
    with open(model_path, encoding="utf-8") as f:
        spec = f.read()
    special_strings(spec)
    model = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_rows = rows.where(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Stretches(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = scan.count_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(F.length("text") <= chunk).select("doc_id", size, "text").mapInArrow(whole, COUNTED)
    counts = count_long(long_rows.select(F.sha2("text", 256).alias("digest"), "text"), model, chunk, overlap)
    long = long_rows.select("doc_id", size, F.sha2("text", 256).alias("digest")).join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long)


def count_long(texts: DataFrame, model, chunk: int, overlap: int) -> DataFrame:
    """``digest, n_tokens`` of huge texts, however often each stands in ``texts``."""
    margin = overlap + Stretches(model.value).reach
    piece_kind = pa.schema([("digest", pa.string()), ("no", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("at_end", pa.bool_()), ("value", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                starts = range(0, len(text), chunk)
                for no, start in enumerate(starts):
                    end = start + chunk + margin
                    row = {"digest": digest, "no": no, "start": start, "last": no + 1 == len(starts), "at_end": end >= len(text), "value": text[start:end]}
                    yield pa.RecordBatch.from_pylist([row], schema=piece_kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, kind = Stretches(model.value), pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for start, last, at_end, value in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "at_end", "value"))):
                at, n = scan.trusted(value, at_end)
                head, tail = at <= margin, at >= chunk
                before = np.flatnonzero(at <= chunk)[-1]
                out[0].append(int(n[-1]))
                out[1].append({"at": start + int(at[before]), "n": int(n[before])})
                out[2].append(list(zip((at[head] + start).tolist(), n[head].tolist())))
                out[3].append([] if last else list(zip((at[tail] + start).tolist(), n[tail].tolist())))
            near = pa.struct([("at", pa.int64()), ("n", pa.int64())])
            made = [pa.array(c, k) for c, k in zip(out, (pa.int64(), near, kind, kind))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("no"), batch.column("last"), *made], names=["digest", "no", "last", "n", "near", "head", "tail"])

    scanned = durable(texts.mapInArrow(cut, PIECES).dropDuplicates(["digest", "no"]).mapInArrow(read, SCANNED))
    right = scanned.select("digest", (F.col("no") - 1).alias("no"), F.col("head").alias("other"))
    meets = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("other")))
    seams = scanned.where(~F.col("last")).join(right, ["digest", "no"]).withColumn("meet", meets)
    share = F.element_at("tail", F.col("meet")) - F.element_at("other", F.col("meet"))
    seams = durable(
        seams.select(
            "digest", F.col("no").alias("first"), (F.col("no") + 1).alias("next"), F.col("near.at").alias("at"), F.col("near.n").alias("n"),
            ((F.col("no") + 1) * F.lit(chunk)).cast("long").alias("start"), share.alias("share"),
        )
    )
    shares = [seams.where("share is not null").select("digest", "share"), scanned.where("last").select("digest", F.col("n").alias("share"))]
    left, width = seams.where("share is null"), overlap
    while not left.isEmpty():
        width *= GROWTH
        if width > chunk:
            left = joined_seams(left)
        seams = durable(widened(texts, left, model, width))
        shares.append(seams.where("share is not null").select("digest", "share"))
        left = seams.where("share is null")
    return reduce(DataFrame.unionByName, shares).groupBy("digest").agg(F.sum("share").alias("n_tokens"))


def joined_seams(seams: DataFrame) -> DataFrame:
    """Neighbouring open seams as one, from the first's left scan to the last's right scan, so that no text is read twice."""
    order = Window.partitionBy("digest").orderBy("first")
    begins = F.coalesce(F.lag("next").over(order) != F.col("first"), F.lit(True))
    runs = seams.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    ends = [F.min_by(c, "first").alias(c) for c in ("at", "n")] + [F.max_by(c, "first").alias(c) for c in ("next", "start")]
    return runs.groupBy("digest", "run").agg(F.min("first").alias("first"), *ends)


def widened(texts: DataFrame, seams: DataFrame, model, width: int) -> DataFrame:
    """Open seams read again, ``width`` characters into the right scan: from the left scan's last border, and from the right scan's start."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, asked in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "asked"))):
                for s in asked:
                    end = s["start"] + width + reach
                    row = {"digest": digest, **s, "at_end": end >= len(text), "value": text[s["at"] : end]}
                    yield pa.RecordBatch.from_pylist([row], schema=cut_kind)

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Stretches(model.value)
        for batch in batches:
            shares = []
            for row in batch.select(["at", "n", "start", "at_end", "value"]).to_pylist():
                skip = row["start"] - row["at"]
                left, n = scan.trusted(row["value"], row["at_end"])
                right, m = scan.trusted(row["value"][skip:], row["at_end"])
                _, i, j = np.intersect1d(left, right + skip, return_indices=True)
                shares.append(row["n"] + int(n[i[0]] - m[j[0]]) if len(i) else None)
            columns = [batch.column(c) for c in ("digest", "first", "next", "at", "n", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shares, pa.int64())], names=["digest", "first", "next", "at", "n", "start", "share"])

    reach = Stretches(model.value).reach
    kinds = {"digest": pa.string(), "first": pa.int32(), "next": pa.int32(), "at": pa.int64(), "n": pa.int64(), "start": pa.int64(), "at_end": pa.bool_(), "value": pa.string()}
    cut_kind = pa.schema(list(kinds.items()))
    asked = seams.groupBy("digest").agg(F.collect_list(F.struct("first", "next", "at", "n", "start")).alias("asked"))
    once = texts.join(asked.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    cut_ddl = "digest string, first int, next int, at long, n long, start long, at_end boolean, value string"
    pieces = once.join(asked, "digest").mapInArrow(slices, cut_ddl)
    return pieces.repartition("digest", "first").mapInArrow(splice, SEAM)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_limit(count_tokens(documents(spark, sf_dir), default_model()))


def over_limit(counted: DataFrame, most: int = TOKEN_LIMIT) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > most)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
