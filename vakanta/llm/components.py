"""Connected components by alternating large and small stars, every step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select("m", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Is every node either a root or hung once, on a root? Then all components are stars."""
    ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("hung")).union(edges.select("b", F.lit(1)))
    each = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("hung").alias("hung"))
    return each.filter("hung > 0 and n > 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), a < b; the root is the smallest node reachable.

    Steps run until all components are stars; their number grows with the logarithm of the nodes, not with the length
    of chains. Only the answer whether they are reaches the driver.
    """
    now = checkpointed(edges.select("a", "b").distinct())
    while not _settled(now):
        now = checkpointed(_small_star(_large_star(now)))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
