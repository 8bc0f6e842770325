"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) with the components of links (a, b).

    A bounded helper for one task's batch: n links never become more than
    one link for each node.
    """
    if len(a) == 0:
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[:len(a)], inverse[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _marks(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): each linked node ``u`` with ``v``, the smallest node it can reach (u itself left out).

    Nodes are longs. Each half step takes a grouped minimum (combined on the
    map side) and joins it back from a written table, so that both join sides
    are plain exchanges and AQE can split the centre of a large star. Links
    stay linear in the nodes and never reach the driver. An empty link table
    gives an empty result.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u <> v").distinct(), "links")
    marks = _marks(edges)
    while marks[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-min")
        large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        last, marks = marks, _marks(edges)
        if marks == last:
            break
    return edges
