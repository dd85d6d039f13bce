"""Connected components by alternating star contractions, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.groups import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): two nodes each, ids that can be ordered. Returns (node, component): the
    smallest node reachable, for every node of an edge.

    Each round joins every node to the least neighbour found; the rounds needed grow with the
    logarithm of the longest chain. A node's neighbours are never gathered in one place.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.distinct())
    seen = _state(edges)
    while True:
        # Every node tells its larger neighbours of the least node around.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Every node joins its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = _state(edges)
        if state == seen:
            break
        seen = state
    # Now every edge leads from a node to its component's least node.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
