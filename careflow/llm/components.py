"""Connected components of links that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long): the smallest node reachable from it.

    Alternates large-star and small-star steps, each a minimum per node joined back to the links, until
    the links are stars around the smallest nodes; the number of rounds grows with the logarithm of the
    longest path. Links with a NULL end are no links; a link of a node to itself makes it a component.
    The minima are dealt out anew before they are joined, so that both sides of the join are exchanges of their own and adaptive execution may split
    the links of a node that many others are linked to. Every round is stored in the shared folder in place of the one before. The driver sees two numbers a round.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    loops = links.select(F.col("a").alias("node")).union(links.select("b"))
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        edges, old = stored(_small_star(_large_star(edges)), "links"), edges
        discard(old)
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(loops.select("node", "node"))
        .groupBy("node").agg(F.min("component").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least")).hint("rebalance")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).hint("rebalance")
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()
