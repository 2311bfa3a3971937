"""Connected components of an edge table by alternating stars.

Every step is a join and an aggregation over the edges; nothing of the graph is
ever gathered.  Each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Greater neighbours of each node go to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its least node."""
    e = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a <> b").distinct()
    e = materialize(e, "edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        e = materialize(_small_star(_large_star(e)), "edges", instead_of=e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
