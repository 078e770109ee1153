"""Connected components by contraction; no vertex, link or component leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links(a, b): nodes have the same label if and only if links connect them.

    Each round points every node at the smallest of its neighbours and itself, follows the pointers one step further, and puts
    the nodes they lead to in the place of the links' ends. Links within such a group vanish, so a star is gone after one
    round and a path of n links after about log n. Joins are on a node, minima by node: a hub's rows are summed before they are
    dealt out, and its side of a join is one that adaptive execution can split. Each round is written to the shared folder, so
    lineage stays short and a lost executor is recovered from files.
    """
    links = materialize(links.select("a", "b").where("a <> b"), "links")
    labels = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        near = materialize(near, "near")
        further = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = materialize(near.join(further, "up", "left").select("node", F.coalesce("top", "up").alias("top")), "tops")
        if labels is None:
            labels = tops.select("node", F.col("top").alias("label"))
        else:
            moved = labels.join(tops.withColumnRenamed("node", "label"), "label", "left")
            labels = materialize(moved.select("node", F.coalesce("top", "label").alias("label")), "labels")
        end = lambda c: tops.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))
        led = links.join(end("a"), "a").join(end("b"), "b").where("top_a <> top_b")
        links = materialize(led.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
