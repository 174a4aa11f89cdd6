"""Connected components of edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (its smallest id) for every id in the edges ``a``, ``b`` (longs).

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour, by
    a grouped minimum and a join: a node with many edges is never collected. Rounds end
    when no edge changes; their number grows with the logarithm of the longest chain.
    No edges give no rows; loops and repeated edges change nothing.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if was == state:
            members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
