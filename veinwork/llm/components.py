"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import discard, materialise


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    The edges shrink to stars around each component's smallest node in a number of rounds that grows with the
    logarithm of the longest path. Each round is written, so a lost executor costs one round at most, and the one before is deleted.
    Loops and repeated edges do no harm; no edges, no rows.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), label)
    while not _are_stars(now):
        # All neighbours of b that are smaller are its parents, so the smallest is the least of them. Their table is
        # written, so both sides of the join are plain shuffles and adaptive execution can split the edges of a node
        # that very many others hang on.
        parents = materialise(now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"), label)
        then = materialise(_small_star(_large_star(now, parents)), label)
        discard(now, parents)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent or is one, but not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("child")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("child")))
    return ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("child").alias("child")).filter("parents > 1 OR parents = 1 AND child = 1").isEmpty()


def _large_star(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself). parents: node and its smallest neighbour m."""
    return edges.join(parents, edges["b"] == parents["node"], "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
