"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's smallest node.

    Each round a node takes the smallest label around it, then its label's label, so long chains
    shrink to half; every round is a written table.  An edge table without rows has no nodes.
    """
    edges = edges.where("a <> b")
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", 2 * edges.count())
    n = both.count()
    labels = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), f"{name}-labels", n)
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        near = saved(near, f"{name}-near-{step}", n)
        new = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("new"))
        new = saved(new, f"{name}-new-{step}", n)
        jump = new.select(F.col("node").alias("to"), F.col("new").alias("further"))
        labels = saved(new.join(jump, new["new"] == jump["to"], "left").select("node", F.coalesce("further", "new").alias("label"), (F.col("label") != F.col("new")).alias("moved")), f"{name}-labels-{step}", n)
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
