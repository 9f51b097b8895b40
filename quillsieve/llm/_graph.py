"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) pairs of longs -> (node, component), component being the smallest node that is reachable.

    Every round joins the edges with each node's smallest neighbour and is written out; the rounds end when the edges
    are stars around their smallest nodes, however many that takes (their number grows with the square of the logarithm of
    the nodes at most). The smallest neighbours are found by a partial aggregation and written before they are joined, so that
    the adaptive skew join can split a node with very many edges. Nodes without an edge to another node are not returned.
    Nulls are dropped.
    """

    def distinct(df: DataFrame, at: str) -> tuple[DataFrame, tuple]:
        df = scratch.save(df.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-{at}")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, mark = distinct(edges.select("a", "b"), "0")
    k = 0
    while True:
        k += 1
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"{name}-{k}-least")
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"{name}-{k}-large")
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}-star")
        small = large.join(least.hint("merge"), "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        was = mark
        now, mark = distinct(small, str(k))
        scratch.drop(f"{name}-{k - 1}", *(f"{name}-{k}-{x}" for x in ("least", "large", "star")))
        if mark == was:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
