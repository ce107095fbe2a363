"""Connected components of a table of links, by rounds of contraction in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_landed, land


def roots_of(links: DataFrame, tag: str) -> DataFrame:
    """node, root for every node in links (a, b: of one orderable type): root is the smallest node of its component.

    Each round gives every node its smallest neighbour, follows these pointers a few steps, and relabels the links; links
    within a component vanish, so the links left shrink by a factor each round. Only counts reach the driver. Null ends
    and loops are ignored.
    """
    left = land(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
    steps = []
    while left.limit(1).count():
        up = left.select(F.col("b").alias("node"), F.col("a").alias("to")).groupBy("node").agg(F.min("to").alias("to"))  # a is smaller: up holds all nodes but local minima
        up = land(up, f"{tag}-up")
        for _ in range(3):
            hop = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.node"), "left").select(F.col("x.node"), F.coalesce("y.to", "x.to").alias("to"))
            up = land(hop, f"{tag}-up")
        for end in ("a", "b"):
            moved = up.select(F.col("node").alias(end), F.col("to").alias("_to"))
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        left = land(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
        steps.append(up)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Nodes that lose their pointer's target in a later round follow it there.
    total = steps[-1]
    for up in reversed(steps[:-1]):
        later = total.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        moved = up.join(later, "to", "left").select("node", F.coalesce("_to", "to").alias("to"))
        own = total.join(up.select("node"), "node", "left_anti")
        total = land(moved.unionByName(own), f"{tag}-up")
    tops = total.select(F.col("to").alias("node")).distinct().join(total.select("node"), "node", "left_anti").select("node", F.col("node").alias("to"))
    out = land(total.unionByName(tops).select("node", F.col("to").alias("root")), f"{tag}-roots")
    drop_landed(left)
    return out


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (root of each index, the smallest of its group) after links a-b."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
