"""SentencePiece encoding with source spans, and decoding.

A text is normalised by longest prefix through the model's compiled character map, and every
normalised byte keeps the source byte it came from.  The library merges pieces over the
normalised text, and piece ends are projected to source bytes through the alignment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import documents

SPACE = "▁"
ENCODED = "doc_id long, ids array<int>, ends array<int>, decoded string"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 keys, then replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.out = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Bytes consumed at ``at`` by the longest key and its replacement, or one character as it is."""
        best = None
        if self.units:
            node = _offset(self.units[0])
            for i in range(at, len(raw)):
                node ^= raw[i]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != raw[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best:
            return best[0], self.out[best[1] : self.out.index(b"\0", best[1])]
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, raw[at : at + size]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised text, and for each of its bytes (and its end) the source byte."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.mark = SPACE.encode() if self.escape else b" "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(raw, np.uint8)
            wide = np.where(source == 0x20, len(self.mark), 1)
            head = len(self.mark) if self.prefix else 0
            align = np.concatenate([np.zeros(head, np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])
            return (self.mark.decode() if self.prefix else "") + text.replace(" ", self.mark.decode()), align
        return self._mapped(raw)

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        steps, at = [], 0
        while at < len(raw):
            size, out = self.map.longest(raw, at)
            steps.append((at, out))
            at += size
        end = len(raw)
        if self.squeeze:
            while steps and steps[0][1] in (b" ", b""):
                steps.pop(0)
        out, align = bytearray(), []

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if steps and self.prefix:
            put(self.mark, steps[0][0])
        spaced = self.squeeze
        for source, piece in steps:
            if spaced:
                piece = piece.lstrip(b" ")
            for byte in piece:
                put(self.mark if byte == 0x20 else bytes([byte]), source)
            if piece:
                spaced = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                end = align[-len(self.mark)]
                del align[-len(self.mark) :]
        return out.decode(), np.array([*align, end], np.int64)


class Codec:
    """One model in one worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.normalize = Normalizer(spec.normalizer_spec)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.unknown = self.library.unk_id()
        plain = spec.normalizer_spec
        plain.precompiled_charsmap, plain.add_dummy_prefix, plain.remove_extra_whitespaces = b"", False, False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and each piece's end in source bytes (a piece begins where the one before ends)."""
        normal, align = self.normalize(text)
        ids = self.raw.encode(normal)
        if not ids:
            return ids, np.zeros(0, np.int64)
        width = self.width[ids]
        if self.unknown in ids:  # only without byte fallback: its width is what the text has there
            width = np.array([len(p.encode()) for p in self.raw.encode(normal, out_type=str)])
        return ids, align[np.cumsum(width)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, ends, decoded`` of every row of ``docs``.

    Encoding is the library's own (no begin or end ids, no sampling); piece ``i`` covers source
    bytes ``ends[i-1]`` to ``ends[i]``.  A null or empty text has no ids and decodes to an empty
    text.  Rows repeated are encoded alike; an empty table gives no rows.  The model file is read
    once by the caller and travels with the task (it is a fixed half megabyte).
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                coded = [codec.encode(t or "") for t in texts]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(c[0]) for c in coded])]).astype(np.int32))
                flat = np.fromiter(chain.from_iterable(c[0] for c in coded), np.int32)
                ends = np.concatenate([c[1] for c in coded]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(flat)),
                        pa.ListArray.from_arrays(bounds, pa.array(ends)),
                        pa.array([codec.decode(c[0]) if c[0] else "" for c in coded], pa.string()),
                    ],
                    names=["doc_id", "ids", "ends", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), default_model()))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )
