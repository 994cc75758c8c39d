"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    # the sum is of 31-bit values, so that it can't overflow before 2^32 edges
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31 - 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge, root being the least node of its component.

    ``edges`` has columns ``u`` and ``v``; direction, self-loops and repeated edges don't matter. Each
    step is one shuffle by node with a windowed minimum, so a node of any degree is streamed and never
    collected. Each round is written to the checkpoint folder, which bounds the lineage.
    """
    nodes = Window.partitionBy("u")
    edges = cut(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(nodes)))
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        small = large.withColumn("m", F.min("v").over(nodes))
        edges = cut(
            small.select(
                F.explode(
                    F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
                ).alias("e")
            )
            .select("e.u", "e.v")
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    root = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of edges (u, v) without a cycle that join what all of them join."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root, kept = np.arange(len(nodes)), [np.empty(0, np.int64)]
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        first = np.full(len(nodes), len(u))  # of the edges that leave each tree
        np.minimum.at(first, root[a[open_]], open_)
        np.minimum.at(first, root[b[open_]], open_)
        new = np.unique(first[first < len(u)])
        kept.append(new)
        while (unlike := root[a[new]] != root[b[new]]).any():
            low, high = np.minimum(root[a[new]], root[b[new]])[unlike], np.maximum(root[a[new]], root[b[new]])[unlike]
            to = np.arange(len(nodes))
            np.minimum.at(to, high, low)
            root = to[root]
    return np.concatenate(kept)
