"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.llm.common import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """Every (node, neighbour) with the smallest neighbour of the node. The
    minimum is pre-aggregated; a hub meets its neighbours in a plain join,
    which the planner can split."""
    low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    return edges.join(materialise(low, "component-low"), F.col("u") == F.col("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both)
    return near.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    return near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        near.select("u", F.col("m").alias("v")))


def component_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edge table (columns a, b) that is not
    its component's smallest node; root is that smallest node.

    Nothing is collected: a round is two joins and a written table, and the
    rounds grow with the logarithm of a component's length. Ends when a round
    leaves the edges as they were.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "component-edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        edges = materialise(_small_star(_large_star(edges).distinct()).filter("u != v").distinct(),
                            "component-edges")
