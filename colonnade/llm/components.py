"""Connected components by alternating large and small stars, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of edges a, b.

    A large star links each greater neighbour of a node to the least node around it, a small star
    each smaller one; both keep the components and end in one star a component, after a number of rounds that
    grows with the logarithm of the size. The state is a written table after each round, so
    nothing is gathered and a lost executor costs no earlier round. A node's neighbours are
    aggregated to their minimum, map-side first, and that one row is joined to its edges; a hub's edges
    are one key of this join, whose larger side is split where it's skewed (AQE), and are streamed, not held.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(edges)
    for k in range(rounds):
        if not mark[0]:
            break
        both = _both(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a != b").distinct(), f"{name}-{k}")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
