"""Connected components of an undirected edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.session import checkpoint


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    ``edges``: any two orderable columns of one type; direction, order, repeats, self
    loops and null ends (dropped) don't matter. Returns (node, component). Each round
    makes every node point at the smallest node it knows and hands that on to its
    larger neighbours; the edge count never grows, and rounds grow with the logarithm
    of the longest path. Every round ends in a reliable checkpoint.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    before = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of each node go to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of each node, and the node, go to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(low, "u")
        small = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = checkpoint(small)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
