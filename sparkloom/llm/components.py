"""Connected components of a graph in a table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or not larger) neighbours to the least of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = pairs.join(least, "u")
    if large:
        linked = both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = both.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b) reaches.

    Rounds of stars, whose edges all point to smaller nodes; a hub costs its
    number of edges and is never gathered in one place.  The number of rounds
    grows with the logarithm of the components' size.  Loops and repeated
    edges are allowed; no edges give no rows.
    """
    small = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = small.select(F.col("a").alias("u"), F.col("b").alias("v")).union(small.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        last, small = small, written(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "edges")
        removed(last)
        now = tuple(small.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first())
        if now == mark:
            return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
