"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.session import stage


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (``a``, ``b``) with the least node of its component.

    Returns ``node``, ``label``. Large-star and small-star steps are repeated until the edges
    stay the same: each step links the neighbours of a node to its least neighbour, first the
    larger ones, then the smaller ones and the node itself. The number of rounds grows with
    the logarithm of the nodes; minima are combined before each shuffle, and joins on a hot
    node can be split by adaptive execution.
    """
    links = edges.filter("a is not null and b is not null and a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # the same set of edges again: all point at the least node
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
