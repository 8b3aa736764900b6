"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component.

    Each round keeps at most as many edges as it got and every round is written, so the lineage
    stays short. The rounds grow with the logarithm of the longest chain. Loops and repeated
    edges do nothing; no edges give no rows.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a != b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node without others below it straight to a root."""
    each = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)).distinct())
    return each.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 or (down > 0 and n > down)").isEmpty()
