"""Exact deduplication with a heavy-hitter split, on DataFrame functions only.

Misra-Gries counters (``DataFrame.freqItems``) name every digest that may hold more than
``support`` of all rows; there are at most ``1 / support`` of them, so their exactly counted
winners can be broadcast and their rows never shuffle.  All other digests are rarer than
that and meet in an ordinary shuffle, which moves ids and digests but no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import documents, durable, fresh

SUPPORT = 0.001


def digest_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, digest, keep_id, group_size, kept``.

    Texts are equal when identical (null counts as empty); the largest ``doc_id`` of a group
    stays.  Rows repeated with one id are counted apart, and all of them carry the same answer.
    A null ``doc_id`` sorts below every other.  An empty table gives no rows.
    """
    rows = durable(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    group = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    candidates = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # At most 1 / support candidates: verified with exact counts over all rows.
    found = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*group)
    heavy = durable(found)
    at_map_side = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    ordinary = rest.join(rest.groupBy("digest").agg(*group), "digest")
    both = at_map_side.unionByName(ordinary)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Rows fall by id and text together, so a null or repeated id loses only its copies.  Of rows
    equal in both the smallest by the columns in order stays.
    """
    of_id, of_text, digest, stays = (fresh(docs.columns, n) for n in ("of_id", "of_text", "of_digest", "stays"))
    counted = digest_groups(docs, support).groupBy("doc_id", "digest").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = counted.where(~F.col("kept") | (F.col("n") > 1))
    marked = durable(marked.select(F.col("doc_id").alias(of_id), F.col("digest").alias(digest), F.col("kept").alias(stays)))
    texts = docs.withColumn(of_text, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(of_text) == F.col(digest))
    single = texts.join(marked, same, "left_anti").select(*docs.columns)
    repeated = marked.where(F.col(stays))
    if repeated.isEmpty():
        return single
    # Minima combine before the shuffle, so a row that stands very often costs one row a task.
    several = texts.join(repeated, same, "left_semi").groupBy("doc_id", of_text).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(several.select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = digest_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
"""
