"""Connected components by alternating large-star and small-star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Edges go from the larger node `a` to the smaller `b`.

    Large star: each node's larger neighbours move to its smallest neighbour.
    Small star: each node's smaller neighbours (and itself) do.
    Minima are pre-aggregated, and the join back is one that Spark can split
    for a node with very many neighbours; it is a merge, as a broadcast in each
    round would have the driver hold tables that grow with the edges.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node without larger neighbours keeps its edge through that neighbour's own entry
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, kept: Kept, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges `a`, `b`; a component's name is its smallest node.

    Each pair of rounds is written to the shared folder; it ends when a pair
    changes nothing: the edges are then stars around the smallest nodes.
    """
    edges = kept.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(most_rounds):
        new = kept.write(_round(_round(edges, True), False))
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        kept.drop(edges)
        edges = new
        if (n, total) == mark:
            break
        mark = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", F.col("b").alias("component")).distinct()
    )
