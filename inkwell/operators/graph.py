"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import settle


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether no node has two smaller neighbours and no smaller neighbour has one itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Alternates large and small stars until the edges are stars: every node has one edge and no centre has one of
    its own. That takes a number of rounds that grows with the logarithm of the longest path. Every round is
    checkpointed, so a lost executor costs one round. Loops and repeated edges are ignored; a node whose only
    edges are loops is its own component.
    """
    # settled before anything is derived from it: edges that come out differently when computed again would lose nodes
    every = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = every.where("u <> v")
    while not _are_stars(e):
        e = settle(_small_star(_large_star(e)))
    nodes = every.select(F.col("u").alias("node")).unionByName(every.select(F.col("v").alias("node"))).distinct()
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
