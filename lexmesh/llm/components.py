"""Connected components by alternating large-star and small-star steps, as grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.storage import discard, written


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge's upper end linked with the minimum of its lower one.

    The minima are stored before they meet the edges: Spark knows their size and sends them around if they are few; else the join has an
    exchange of its own, in which adaptive execution can split a node of very many links.
    """
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step, as a stored table."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    large = written(_star(both.filter("v > u"), least).distinct(), "edges")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lower = written(down.groupBy("u").agg(F.min("v").alias("m")), "minima")
    small = written(_star(down, lower).union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(least, large, lower)
    return small


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (u, v) links; the root is the smallest node of the component.

    A step moves edges, never whole components; a node with very many links is combined in each task before its
    minimum is taken. The number of rounds grows with the logarithm of the longest path.
    """
    edges = written(links.filter("u <> v").select("u", "v").distinct(), "edges")
    state = _signature(edges)
    while True:
        earlier, edges = edges, _step(edges)
        discard(earlier)
        after = _signature(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
