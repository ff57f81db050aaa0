"""Connected components, and worlds as components of agents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspan.sources.io import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) reaches.

    Each round gives a node the smallest label among its neighbours and then follows labels one
    step; rounds are checkpointed, and end when no label changes.
    """
    e = edges.filter("u is not null and v is not null").select("u", "v")
    e = checkpointed(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(e.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).select(F.col("u").alias("node"), F.col("l").alias("label")))
    for _ in range(rounds):
        near = e.join(labels, e.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = checkpointed(step.join(up, step.label == up.n2).select("node", "old", F.col("l2").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def plan_worlds(revisions: DataFrame, least: int = 2, most: int | None = None, cap: int | None = None) -> DataFrame:
    """(world, agents, pages): components of the graph of agents and pages they edit, with their
    number of agents in bounds (most: none, so that no world is lost for its size), largest first. revisions: agent, page (texts)."""
    named = revisions.select(F.concat(F.lit("a:"), F.col("agent")).alias("u"), F.concat(F.lit("p:"), F.col("page")).alias("v")).distinct()
    c = components(named)
    per = c.groupBy("component").agg(F.min(F.when(F.col("node").startswith("p:"), F.expr("substring(node, 3)"))).alias("world"), F.count_if(F.col("node").startswith("a:")).alias("agents"), F.count_if(F.col("node").startswith("p:")).alias("pages"))
    bounds = F.col("agents") >= least if most is None else F.col("agents").between(least, most)
    rows = per.filter(bounds).select("world", "agents", "pages").orderBy(F.desc("agents"), "world")
    return rows.limit(cap) if cap else rows
