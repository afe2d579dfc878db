"""Distributed union-find: the connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.llm.shared import stored


def _least(edges: DataFrame) -> DataFrame:
    """Per node, the lowest node among its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's higher neighbours are hung on its lowest one (or on itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lower neighbours are hung on the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = _least(down)
    hung = down.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionByName(low.select("u", F.col("low").alias("v")))


PART = 100_000  # edges that a task writes, roughly


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none: its component's lowest."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hung = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.select("u").unionByName(hung).isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node that an edge touches; a component is its lowest node.

    ``edges`` is (u, v), of any orderable type; loops, repeats and both directions may occur.
    Rounds of large and small stars until each node hangs on its root; each is a minimum per
    node, taken before the shuffle, and a join with one row per node, so a node with very
    many neighbours is neither gathered nor a task's own burden. Every round's edges are
    written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of
    the longest chain; past ``most`` an error is raised rather than a wrong answer given.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    # A few edges need not be as many files as a large table's shuffle has parts; rounds add none.
    parts = max(8, now.count() // PART)
    for _ in range(most):
        if _settled(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        now = stored(small_star(large_star(now)).distinct().coalesce(parts), "links")
    raise RuntimeError(f"components did not settle in {most} rounds")
