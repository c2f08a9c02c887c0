"""Connected components by alternating star contraction, on edge tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Each round hangs the larger neighbours of a node under the smallest neighbour (large star), then the
    smaller ones (small star). Neighbour minima are partial aggregates; the joins that follow can be split
    by AQE when one node has very many edges. Rounds grow with the logarithm of the longest chain.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    leaves = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
