"""Connected components of a graph given as an edge table, by alternating large-star and
small-star rounds: every round is joins and pre-aggregated minima, and no node, link or
component ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(low)
    moved = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link between different nodes; component is the
    component's smallest node. Nodes are longs; links may repeat and point either way; a
    link with a null end, or from a node to itself, has no effect."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges, before = materialise(edges.distinct()), None
    for _ in range(max_rounds):
        edges = _small_star(_large_star(edges)).filter("u <> v").distinct()
        edges = materialise(edges)
        now = tuple(
            edges.agg(
                F.count("*"),
                F.sum(F.col("v").cast("decimal(38,0)")),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
