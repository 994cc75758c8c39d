"""Bounded breadth-first subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import local_name
from ..session import BROADCAST_ROWS, cut
from .patterns import match, types


def edges_between(triples: DataFrame, direction: str = "both", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(a, b): steps along the edges between nodes, by full names to include and local names to exclude."""
    rows = triples.filter((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE))
    if include:
        rows = rows.filter(F.col("p").isin(*include))
    if exclude:
        rows = rows.filter(~local_name(F.col("p")).isin(*exclude))
    out, back = rows.select(F.col("s").alias("a"), F.col("o").alias("b")), rows.select(F.col("o").alias("a"), F.col("s").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def k_hop(
    triples: DataFrame, start: DataFrame, hops: int = 2, direction: str = "both", include: list[str] | None = None, exclude: list[str] | None = None,
    include_types: list[str] | None = None, exclude_types: list[str] | None = None, min_degree: int = 0, max_nodes: int | None = None,
) -> DataFrame:
    """(e, depth): the nodes within ``hops`` steps of the nodes ``e`` of ``start``, which need a type to be entered.

    A hop joins the frontier, broadcast only while it is counted to be small, with the edges, and takes away
    what was reached before. With ``max_nodes`` the nearest are kept, by name within a depth. Each hop is
    written to the checkpoint folder.
    """
    steps = edges_between(triples, direction, include, exclude)
    allowed = types(triples)
    if include_types:
        allowed = allowed.filter(F.col("t").isin(*include_types))
    nodes = allowed.select(F.col("s").alias("e")).distinct()
    if exclude_types:
        nodes = nodes.join(types(triples).filter(F.col("t").isin(*exclude_types)).select(F.col("s").alias("e")), "e", "left_anti")
    if min_degree:
        both = edges_between(triples).groupBy(F.col("a").alias("e")).agg(F.count("*").alias("n"))
        nodes = nodes.join(both.filter(F.col("n") >= min_degree).select("e"), "e", "left_semi")
    reached = cut(start.select("e").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        front = reached.filter(F.col("depth") == depth - 1).select(F.col("e").alias("a"))
        n = front.count()
        if not n:
            break
        step = steps.join(F.broadcast(front) if n <= BROADCAST_ROWS else front, "a", "left_semi").select(F.col("b").alias("e")).distinct()
        new = step.join(reached, "e", "left_anti").join(nodes, "e", "left_semi").withColumn("depth", F.lit(depth))
        if max_nodes is not None:
            new = new.orderBy("e").limit(max(0, max_nodes - reached.count()))
        reached = cut(reached.unionByName(new))
    return reached


def subgraph(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends are in ``nodes``."""
    ends = nodes.select("e").distinct()
    rows = triples.filter((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE)).select("s", "p", "o")
    return rows.join(ends.withColumnRenamed("e", "s"), "s", "left_semi").join(ends.withColumnRenamed("e", "o"), "o", "left_semi").select("s", "p", "o")


def nodes_by_type(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    t = types(triples).withColumnRenamed("s", "e")
    return nodes.join(t, "e", "left").groupBy(F.coalesce("t", F.lit("none")).alias("type")).agg(F.count_distinct("e").alias("nodes"))


def instance_subgraph(triples: DataFrame) -> DataFrame:
    """All triples of instances."""
    return triples.join(match(triples, p=V.TYPE, o=V.INSTANCE).select("s").distinct(), "s", "left_semi")
