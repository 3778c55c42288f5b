"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node, itself included. Written, so that the join with the edges shuffles
    both sides and Spark can split a node that has many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return written(least.select(F.col("u").alias("w"), F.least("m", "u").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, u != v, any direction, repeats allowed). Returns node and root, the least node
    of its component, for every node of an edge.

    Each round links the neighbours of every node to the least of them; the number of rounds grows with
    the logarithm of the longest path. Only (node, node) pairs move; minima are aggregated before the
    shuffle, and joins on a node with many edges are ones that Spark can split. Every round is written
    to the shared folder.
    """
    now = written(edges.select("u", "v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least one
        large = (
            both.join(_least(both), both.u == F.col("w"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: a node and its smaller neighbours go to the least of them
        least = _least(large)
        small = (
            large.join(least, large.u == F.col("w"))
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        nxt = written(small, "edges")
        # done when every node has one edge, to a node that has none of its own
        stars = nxt.groupBy("u").count().filter("count > 1").limit(1).count() == 0
        if stars and nxt.join(nxt.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() == 0:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        now = nxt
