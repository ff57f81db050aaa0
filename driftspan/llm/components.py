"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest in its neighbourhood."""
    both = edges.union(edges.select("v", "u")).filter("u is not null")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node each node of edges (u, v) reaches.

    Null ends and self-loops are ignored; nodes without another end do not appear. The number of
    edges never grows, and each node's smallest neighbour is found by a partial aggregation, so a
    hub is no single task's work. Rounds end when the edges are stars, and are checkpointed.
    """
    edges = edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v"))
    edges = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
