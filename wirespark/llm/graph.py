"""Connected components of links between documents, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A node is hot if it has more than this share of all links; so there are at most twice as many hot nodes, a small table.
HOT = 20_000


def relabeled(links: DataFrame, side: str, step: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """links with `name`, the label (step: node, to) of its node at side. Links of hot nodes meet a broadcast table, others a shuffled one."""
    known = links.join(F.broadcast(hot.select(F.col("node").alias(side), F.col("to").alias("hot"))), side, "left")
    cold = known.where("hot IS NULL").drop("hot").join(step.select(F.col("node").alias(side), F.col("to").alias(name)), side)
    return cold.unionByName(known.where("hot IS NOT NULL").withColumnRenamed("hot", name))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes in links (a, b).

    Each round maps every node to the smallest of itself and its neighbours, and the links with it. A node that isn't
    smallest among its neighbours goes, so rounds are logarithmic; a star takes one. The smallest node of a component
    maps to itself in every round, and is what is left.
    """
    left = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while n := left.count():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        step = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("to"), F.count("*").alias("degree")), "steps")
        hot = step.where(F.col("degree") > n / HOT + 8)
        step = step.select("node", "to")
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            hop = step.select(F.col("node").alias("component"), "to")
            labels = staged(labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        moved = relabeled(relabeled(left, "a", step, hot, "x"), "b", step, hot, "y")
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = staged(moved.distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
