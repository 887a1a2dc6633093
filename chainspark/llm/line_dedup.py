"""Line deduplication on DataFrame functions only.

Normalised lines are hashed, the documents holding each hash are counted, lines over the
threshold are dropped except in their first document, and the rest is put together again by
position.  Lines found in a large share of all documents are few by arithmetic (at most
``lines / hot_rows``), so they are broadcast and their rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import ascii_lower, documents, durable

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2
HOT_SHARE = 0.0005


def _line_keys(text: Column, min_chars: int) -> Column:
    """Array with one entry a line: two hashes (96 bits) of its key, null for short keys."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(bare) >= min_chars, F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))

    return F.transform(lines, key)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text`` (kept lines), ``n_lines``, ``n_dropped``.

    A null or empty text is one empty line.  Keys under ``min_chars`` code points always stay.
    A key in ``min_docs`` or more documents stays only in the smallest ``doc_id``, with all its
    repeats there.  Rows repeated with one id are one document and are treated alike.
    A null ``doc_id`` is never the smallest id of a key unless all are null, and keeps its lines.
    """
    keyed = durable(docs.select("doc_id", _line_keys(F.col("text"), min_chars).alias("keys")))
    at = keyed.select("doc_id", F.posexplode("keys").alias("pos", "k")).where("k is not null")
    at = at.select("doc_id", "pos", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
    counted = at.select("doc_id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    repeated = durable(counted.where(F.col("n") >= min_docs))
    # A key in over hot_share of all rows: at most lines-per-row / hot_share such keys exist.
    limit = max(1000, int(keyed.count() * hot_share))
    hot, cold = repeated.where(F.col("n") > limit), repeated.where(F.col("n") <= limit)
    by_hot = at.join(F.broadcast(hot), ["a", "b"])
    by_cold = at.join(F.broadcast(hot), ["a", "b"], "left_anti").join(cold, ["a", "b"])
    gone = by_hot.unionByName(by_cold).where(F.col("doc_id") > F.col("first"))
    gone = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    whole = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    joined = whole.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # The stretches between dropped positions, so that a long text costs one pass.
    marks = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    stretch = lambda m, i: F.slice("lines", m + 2, F.get("marks", i + 1) - m - 1)
    kept = F.flatten(F.transform(F.slice("marks", 1, F.size("gone") + 1), stretch))
    return joined.withColumn("marks", marks).select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
               lambda x, i: {'pos': i, 'line': x})) AS u FROM documents)),
dup AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, dup.first IS NOT NULL AND l.doc_id <> dup.first AS gone FROM lines l LEFT JOIN dup USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
