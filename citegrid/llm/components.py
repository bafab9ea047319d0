"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.common import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of two longs -> (node, root), root being the smallest node reachable; nodes without edges have no row.

    Alternates large-star and small-star steps until nothing changes: the number of rounds grows with the logarithm of
    the longest path. A node's neighbours meet only in a minimum (summed up before the shuffle) and in a join whose
    large partitions Spark can split, so a node to which a third of all rows link is no trouble. Each round is cut off
    from the one before by a reliable checkpoint. Loops and repeated edges are harmless; null ends are left out.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
        now = checkpoint(now)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
