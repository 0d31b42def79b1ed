"""Connected components by alternating large-star and small-star steps over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """Each vertex tells the smallest of its neighbourhood, which `least` has, to its larger neighbours."""
    told = _both(edges).where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return stored(told.where("u <> v").distinct(), name)


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """Each vertex tells the smallest of its neighbourhood to its smaller neighbours and itself."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    told = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return stored(told.where("u <> v").distinct(), name)


def components(links: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """links: (a, b) as longs. Returns (node, component) for every node that a link names; component is the
    smallest node reachable. Each step is written to the shared folder, so no lineage grows, and the result reads
    the last table written. Edges are (u, v) with u > v, without repeats; they are stars around the components'
    smallest nodes, and the end is reached, when no node with a smaller neighbour has another neighbour."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(most):
        least = stored(_both(edges).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
        if least.where("m < u AND n > 1").count() == 0:
            return least.select(F.col("u").alias("node"), F.least("m", "u").alias("component"))
        edges = _small_star(_large_star(edges, least, name), name)
    raise RuntimeError(f"no fixed point within {most} steps")
