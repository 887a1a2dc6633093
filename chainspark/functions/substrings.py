"""Which texts contain which needles: an inverted index of rare character n-grams, joined, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.sinks.store import cut

GRAM = 4


def grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def contained(needles: DataFrame, texts: DataFrame, by: str = "by") -> DataFrame:
    """``by, needle, text``: pairs of distinct needles (``by, needle``) and texts (``by, text``) of one ``by`` where the text contains the needle.

    Each needle is looked up by the one of its n-grams that fewest needles have (shorter needles by themselves),
    so a text meets only needles of which it holds that n-gram.  Nulls and empty needles match nothing.
    """
    needles = cut(needles.where(F.col(by).isNotNull() & (F.col("needle") != "")).select(by, "needle").distinct())
    width = F.least(F.length("needle"), F.lit(GRAM)).alias("width")
    each = needles.select(by, "needle", width, F.explode(grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    common = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    key = each.join(common, "gram").groupBy(by, "needle").agg(F.min_by("gram", F.struct("n", F.xxhash64("gram"))).alias("gram"))
    # Needles of four widths at most, so the collected list is of that length.
    widths = [r[0] for r in needles.select(width).distinct().collect()]
    texts = texts.where(F.col(by).isNotNull() & F.col("text").isNotNull()).select(by, "text").distinct()
    own = F.flatten(F.array(*[grams(F.col("text"), F.lit(w)) for w in widths])) if widths else F.array().cast("array<string>")
    met = texts.select(by, "text", F.explode(own).alias("gram")).join(key, [by, "gram"])
    return met.where(F.contains("text", F.col("needle"))).select(by, "needle", "text")
