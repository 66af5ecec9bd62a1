"""Connected components by minimum labels with pointer jumping, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


def components(links: DataFrame, scratch: tk.Scratch) -> DataFrame:
    """(node, component): the smallest node reachable from each node of (a, b) links.

    Each round takes the least label of a node's neighbours, gives it to the node's old label
    too, then takes the label of the label. Labels only fall, so the rounds end by themselves;
    trees hook onto trees and flatten, so they grow with the logarithm of the nodes. Hot nodes
    only meet aggregates, and joins whose other side has one row a node. No links give no rows.
    """
    edges = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    moved = True
    while moved:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("new"))
        own = scratch.save(own)
        hooks = own.where("new < old").groupBy(F.col("old").alias("root")).agg(F.min("new").alias("hook"))
        hooked = scratch.save(own.join(hooks, own["node"] == hooks["root"], "left").select("node", "old", F.least("new", "hook").alias("new")))
        of = hooked.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        fresh = scratch.save(hooked.join(of, "new", "left").select("node", "old", F.least("new", "jump").alias("component")))
        moved = fresh.where("component <> old").limit(1).count()
        scratch.drop(labels, own, hooked)
        labels = fresh
    scratch.drop(edges)
    return labels.select("node", "component")
