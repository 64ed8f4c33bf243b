"""Connected components and grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove_scratch


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by its first ``n_keys`` integer columns; one group is held at a time."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, a].tolist())
            if key != last and held:
                yield last, pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_tables(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of ``edges`` (columns a, b): node, component (its smallest node).

    Every round each node points to its smallest neighbour; pointers are followed to their roots by doubling, edges move
    to the roots, and loops and repeats go. Every tree of pointers has two nodes at least, so a round at least halves the
    nodes that still have edges, whatever the diameter; its root is its smallest node. Rounds go on until no edge is
    left; more than ``max_rounds`` of them (2^max_rounds nodes) raise. Hubs are safe: minima are combined before the
    shuffle and the joins are ones whose skewed partitions Spark can split.
    """
    half = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    levels: list[DataFrame] = []
    while not levels or half.limit(1).count():
        if len(levels) >= max_rounds:
            raise RuntimeError(f"connected components are unfinished after {max_rounds} rounds")
        roots = _roots(half, max_rounds)
        levels.append(roots)
        a, b = (roots.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        ends = half.join(a, "a").join(b, "b").where("up_a <> up_b")
        rest = materialize(ends.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "cc-edges")
        remove_scratch(half)
        half = rest
    remove_scratch(half)
    # roots of a round are nodes of the next: labels come from the last round back
    labels = levels.pop()
    while levels:
        below = levels.pop()
        over = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = materialize(below.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "cc")
        remove_scratch(below)
        remove_scratch(labels)
        labels = new
    return labels.select("node", F.col("up").alias("component"))


def _roots(half: DataFrame, max_doublings: int) -> DataFrame:
    """node, up: the root of the node's tree when every node of the edges points to its smallest neighbour.

    Neighbours of neighbours include the node, so a pointer two steps on never rises: the only cycles are pairs, whose
    smaller node is the root.
    """
    both = half.union(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "cc")
    second = least.select(F.col("node").alias("up"), F.col("up").alias("up2"))
    up = F.when((F.col("up2") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up"))
    trees = materialize(least.join(second, "up").select("node", up.alias("up")), "cc")
    remove_scratch(least)
    for _ in range(max_doublings):
        second = trees.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        new = materialize(trees.join(second, "up").select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")), "cc")
        remove_scratch(trees)
        trees = new.select("node", "up")
        if not new.where("moved").limit(1).count():
            return trees
    raise RuntimeError(f"pointers of connected components are unfinished after {max_doublings} doublings")
