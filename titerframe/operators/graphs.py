"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged, unstaged


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components (node, component: its smallest node) of the undirected graph of ``edges``.

    Every edge points from its larger node to its smaller one. In a round each node's larger neighbours are hung on its
    smallest neighbour, then its smaller ones are; edges end as stars around each component's smallest node. Paths halve
    at least, so a chain of n nodes takes about log2(n) rounds; ``rounds`` of them without an end raise. Minima are
    combined before the shuffle, and a round has no more edges than the one before it has edges and nodes.

    Rows with a null end say nothing, one whose ends are equal makes its node a component of its own. An empty table
    gives no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    links = staged(ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
    links, seen = _counted(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        near = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select("hi", "lo")).groupBy("u").agg(F.min("v").alias("v"))
        hung = links.join(near.select(F.col("u").alias("lo"), F.least("u", "v").alias("top")), "lo").select("hi", F.col("top").alias("lo")).distinct()
        top = hung.groupBy("hi").agg(F.min("lo").alias("top"))
        below = hung.join(top, "hi").where("lo <> top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        new, now = _counted(staged(below.union(top.select("hi", F.col("top").alias("lo"))).distinct(), "links"))
        unstaged(links)
        links = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return nodes.join(links, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The table with how many edges it has and a digest of them, by which a round without change is known."""
    n, digest = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return links, (n, digest)
