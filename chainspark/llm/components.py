"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, component`` (smallest reachable vertex) for each vertex of ``edges`` (``a, b``).

    Smallest labels spread over edges; each round a vertex also hands what it heard to its
    label's root, and all follow their label's label, so whole trees hook at once and the rounds
    grow about as the logarithm of a path's length.  Labels only fall, so it ends by itself.
    Minima combine before the shuffle, and each round is cut.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels, F.col("a") == F.col("v")).groupBy(F.col("b").alias("v")).agg(F.min("component").alias("heard"))
        met = labels.join(heard, "v").select("v", F.least("component", "heard").alias("to"), F.col("component").alias("was"))
        # ``least`` skips nulls: a vertex that is nobody's label keeps what it heard itself.
        hooks = met.groupBy(F.col("was").alias("v")).agg(F.min("to").alias("hook"))
        met = met.join(hooks, "v", "left").select("v", F.least("to", "hook").alias("to"), "was")
        jump = labels.select(F.col("v").alias("to"), F.col("component").alias("next"))
        moved = durable(met.join(jump, "to").select("v", F.least("to", "next").alias("component"), "was"))
        labels = moved.select("v", "component")
        if moved.where("component <> was").isEmpty():
            return labels
