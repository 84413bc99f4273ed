"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.sources.storage import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    larger = both.filter(F.col("lo") > F.col("hi")).join(least, "hi")
    return larger.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    around = edges.join(least, "hi")
    below = around.filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return below.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each linked node that is not the least of its component, and that least node.

    Rounds grow with the logarithm of the number of nodes.  Minima are combined before their shuffle,
    each round is a table in shared storage, and nothing but a row count reaches the driver.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi != lo").distinct(), "edges"
    )
    while not edges.isEmpty():
        before, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        discard(before)
        chained = edges.join(edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").select("hi")
        forked = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hi")
        if chained.unionByName(forked).isEmpty():
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
