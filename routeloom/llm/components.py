"""Connected components of an edge table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import checkpointed, forget, spread_join

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it is connected with.

    Every round hooks neighbours to the smallest one they know, first those larger than a node, then those smaller;
    the number of edges never grows. Rounds end when the edges are stars; each is written to the shared checkpoint folder.
    """
    now = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    for _ in range(MAX_ROUNDS):
        total, ends = now.count(), now.groupBy("a").agg(F.count("*").alias("n"))
        many = ends.where("n > 1").select("a").unionByName(now.select(F.col("b").alias("a")).join(now, "a", "left_semi"))
        if not total or many.isEmpty():  # each node has one neighbour, and that has none above it: the edges are stars
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        known = spread_join(both, least, "a", "b", least, 2 * total)
        large = known.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        known = spread_join(large, least, "a", "b", least, 2 * total)
        small = known.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, now = now, checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
