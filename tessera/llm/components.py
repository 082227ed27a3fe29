"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(work: Workspace, links: DataFrame, name: str = "stars") -> DataFrame:
    """From links (a, b) one row (node, root) per linked node, root being the smallest node reachable. Nodes without links are absent.

    Each round groups by node with a minimum, which combines before the shuffle, and joins it back; a join that a hub makes uneven is one that
    adaptive execution can split. Edges stay at most as many as at the start, and the rounds grow with the logarithm of
    the longest path. Each round ends in a written table. Null nodes, loops and repeated links are ignored.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), f"{name}0")
    n, before = 0, None
    while (state := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and state[0]:
        before, n = state, n + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.save(small.union(least).distinct(), f"{name}{n}")
        if n > 1:
            work.drop(f"{name}{n - 2}")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
