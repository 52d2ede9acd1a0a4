"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). A step is a partial minimum per node and an equality join of the edges with
these minima; no node's neighbours are ever gathered in one place, and Spark splits a join
partition in which one node holds most edges. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger node ``a`` to the smaller node ``b``."""
    least = e.groupBy("a").agg(F.min("b").alias("_m"))
    moved = e.join(least, "a").filter("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    ``edges`` has two columns of one orderable type. Self-loops, nulls, repeated and reversed
    edges are harmless; a node with nothing but a self-loop is not listed.
    """
    x, y = edges.columns
    e = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a != b").distinct()
    e, before = stored(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        e = stored(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
