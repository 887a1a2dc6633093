"""Connected components by spreading smallest labels, with root hooks and a pointer jump each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.sinks.store import kept


def components(edges: DataFrame, a: str = "event_a", b: str = "event_b") -> DataFrame:
    """``event_id, component``: smallest id reachable over ``edges``; vertices without edges are absent.

    What a vertex hears also goes to its label's root, so whole trees hook at once and the rounds
    grow about as the logarithm of a path's length.  Labels only fall, so it ends by itself.
    """
    one = kept(edges.select(F.col(a).alias("x"), F.col(b).alias("y")))
    both = one.unionAll(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y")
    label = kept(both.groupBy(F.col("x").alias("v")).agg(F.least(F.col("x"), F.min("y")).alias("l")))
    while True:
        heard = both.join(label, F.col("x") == F.col("v")).groupBy("y").agg(F.min("l").alias("heard"))
        near = label.join(heard, F.col("v") == F.col("y")).select("v", F.least("l", "heard").alias("to"), F.col("l").alias("was"))
        hooks = near.groupBy(F.col("was").alias("v")).agg(F.min("to").alias("hook"))
        near = near.join(hooks, "v", "left").select("v", F.least("to", "hook").alias("to"), "was")
        far = label.select(F.col("v").alias("to"), F.col("l").alias("next"))
        moved = kept(near.join(far, "to").select("v", F.least("to", "next").alias("l"), "was"))
        label = moved.select("v", "l")
        if moved.where("l <> was").isEmpty():
            return label.select(F.col("v").alias("event_id"), F.col("l").alias("component"))
