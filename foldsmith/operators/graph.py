"""Connected components on edge tables [G3, G10]."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.session import drop_scratch, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component = least node.

    Alternating large-star and small-star rounds: each is a partial aggregate and an equi-join that
    AQE can split at hub nodes, and the number of rounds grows with the logarithm of the longest
    path. Every round is written to the shared folder, so no lineage builds up. Self loops and
    repeated edges are allowed; nodes that only have self loops are kept; null ends are ignored.
    """
    x = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = x.where("x = y").select("x").distinct()
    now = materialize(x.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(least).distinct(), "cc")
        drop_scratch(now)
        drop_scratch(large)
        now = new
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    lonely = loops.select(F.col("x").alias("node")).join(out.select("node"), "node", "left_anti")
    return out.union(lonely.select("node", F.col("node").alias("component")))


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the edges a-b: what is left of a group's links need not grow with their number."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
