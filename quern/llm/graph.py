"""Connected components of links, distributed: alternating large-star and small-star rounds.

No adjacency list is ever gathered: a round is a minimum per node (combined on the map side), written as a table of its
own, and a join of the links to it. Both sides of that join are dealt anew, so AQE can split it at a hub, or broadcast
the minima while they are few. Each round is written to the shared folder, so lost executors cost one round and lineage
stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges: (u, v) with u > v. Large: larger neighbours move to the least of u and its neighbours; small: the others do.

    Returns the new edges and the table of minima that they are read from.
    """
    if large:
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = common.materialise(edges.unionByName(upward).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        return upward.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least
    least = common.materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(links: DataFrame) -> DataFrame:
    """links: two columns of one type. Returns (node, label): every linked node and the least node it can reach.

    Nulls and self-links are ignored; repeated links and either direction are fine; no links give no rows.
    """
    a, b = links.columns
    edges = common.materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).head()
        if now[0] == 0 or now == before:
            break
        before = now
        for large in (True, False):
            star, least = _star(edges, large)
            step = common.materialise(star, "stars")
            common.discard(edges)
            common.discard(least)
            edges = step
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())
    out.__dict__["quern_path"] = edges.__dict__["quern_path"]  # for discard, once nothing reads it
    return out


class Forest:
    """Union by least label over numbered items, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
