"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (columns a, b: long).

    Each step sends the neighbours of a node to the smallest of them; steps follow until nothing changes,
    about the logarithm of the longest path.  Edges stay in Spark; only a count and a checksum reach the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots.join(now.select(F.col("a").alias("node")), "node", "left_anti"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(low, "a")
    return joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
