"""Deterministic samples, capped pools and linear channel transforms."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from .staging import staged, unstaged


def drawn(seed: int, row: list[str]) -> Column:
    """A hash of the row's key that every SQL engine has: md5 of seed and values."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row]))


def sample_per_group(df: DataFrame, keys: list[str], row: list[str], n: int, seed: int = 0, ties: list[str] | None = None) -> DataFrame:
    """At most n rows per group without replacement: those whose row key hashes lowest. Every run takes the same.

    Where row keys repeat within a group, ``ties`` names the columns whose smaller values come first.
    """
    order = Window.partitionBy(*keys).orderBy(drawn(seed, row), *row, *(ties or []))
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows per group at evenly spaced places of the order, first and last included."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    # the k-th place is floor(k (n - 1) / (m - 1)); a row stays if some k has it
    k = F.ceil(F.col("__i") * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = (k <= n - 1) & (F.floor(k * (F.col("__n") - 1) / float(n - 1)) == F.col("__i"))
    return rows.where((F.col("__n") <= n) | hit).drop("__i", "__n")


def tail_and_sample(df: DataFrame, keys: list[str], row: list[str], value: str, q: float, n: int, seed: int = 0) -> DataFrame:
    """All rows of the upper tail and a sample of n others per group; ``in_tail`` tells them apart."""
    limit = df.groupBy(*keys).agg(A.quantile(F.col(value), q).alias("__limit"))
    rows = df.join(limit, keys).withColumn("in_tail", F.col(value) >= F.col("__limit")).drop("__limit")
    order = Window.partitionBy(*keys, "in_tail").orderBy(drawn(seed, row), *row)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("in_tail") | (F.col("__r") <= n)).drop("__r")


def pool(df: DataFrame, group: str, row: list[str], per_group: int, total: int, seed: int = 0) -> DataFrame:
    """A capped sample of every group, in group order until the pool is full.

    What groups have room for is settled on their counts (a row per group); no row crosses to another group's task.
    """
    sample = sample_per_group(df, [group], row, per_group, seed)
    counts = df.groupBy(group).agg(F.least(F.count("*"), F.lit(per_group)).alias("__n"))
    room = counts.withColumn("__room", F.lit(total) - (F.sum("__n").over(Window.orderBy(group)) - F.col("__n"))).where("__room > 0")
    order = Window.partitionBy(group).orderBy(drawn(seed, row), *row)
    return sample.join(room.select(group, "__room"), group).withColumn("__r", F.row_number().over(order)).where("__r <= __room").drop("__r", "__room")


def capped(df: DataFrame, keys: list[str], row: list[str], n: int, seed: int = 0) -> DataFrame:
    """The rows that :func:`sample_per_group` takes; groups of at most ``n`` rows, and what is sure of others, stay where they are.

    Groups of more rows (there are fewer than one for every ``n`` rows) are counted by range of the hash; only the rows of
    the range that holds the n-th are put in order.
    """
    ties = [c for c in df.columns if c not in (*keys, *row)]
    own = [f"__k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)], F.lit(True))
    sizes = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]).agg(F.count("*").alias("__n"))
    large = staged(sizes.where(F.col("__n") > n), "large-groups")
    if large.isEmpty():
        unstaged(large)
        return df
    share = F.conv(F.substring(drawn(seed, row), 1, 8), 16, 10).cast("double") / 2.0**32
    at = F.floor(share * F.col("__n") * (16.0 / n))
    counts = df.join(large, same).groupBy(*own, "__n", at.alias("__at")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*own).orderBy("__at"))
    counts = counts.withColumn("__room", n - upto + F.col("__c")).where((F.col("__room") > 0) & (F.col("__room") <= F.col("__c")))
    ends = staged(counts.select(*own, "__n", F.col("__at").alias("__end"), "__room"), "group-ends")  # a row per large group
    unstaged(large)
    met = df.join(ends, same, "left").withColumn("__at", F.when(F.col("__n").isNotNull(), at))
    sure = met.where(F.col("__n").isNull() | (F.col("__at") < F.col("__end"))).select(*df.columns)
    order = Window.partitionBy(*own).orderBy(drawn(seed, row), *row, *ties)
    last = met.where(F.col("__at") == F.col("__end")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__room"))
    return sure.unionByName(last.select(*df.columns))


def pool_per_group(df: DataFrame, keys: list[str], parts: list[str], row: list[str], per_part: int, total: int, seed: int = 0) -> DataFrame:
    """A pool of at most ``total`` rows for every group, from all of its parts (of at most ``per_part`` rows each).

    Rows are taken by lowest hash, under another seed than within the parts. Counts by range of the hash say in which one
    a pool is full: rows beyond it never move, and no task orders a whole group.
    """
    ties = [c for c in df.columns if c not in (*keys, *parts, *row)]
    rows = capped(df, [*keys, *parts], row, per_part, seed)
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed + 1), *parts, *row)).withColumn("__range", F.shiftright("__h", 48))
    counts = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n")
    room = counts.withColumn("__room", F.lit(total) - before).where("__room > 0")
    ends = staged(room.groupBy(*keys).agg(F.max("__range").alias("__end"), F.min("__room").alias("__room")), "pool-ends")
    rows = rows.join(F.broadcast(ends), keys).where(F.col("__range") <= F.col("__end"))  # a row per group
    order = Window.partitionBy(*keys, "__range").orderBy("__h", *parts, *row, *ties)
    taken = (F.col("__range") < F.col("__end")) | (F.col("__r") <= F.col("__room"))
    return rows.withColumn("__r", F.row_number().over(order)).where(taken).select(*df.columns)


def _combined(df: DataFrame, channels: list[str], matrix: np.ndarray) -> DataFrame:
    new = {}
    for j, c in enumerate(channels):
        terms = [F.col(x) * float(matrix[i, j]) for i, x in enumerate(channels) if matrix[i, j] != 0]
        new[c] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return df.withColumns(new)


def compensate(df: DataFrame, channels: list[str], spill: list[list[float]]) -> DataFrame:
    """Channels times the inverse of the spillover matrix, as linear expressions; the matrix is inverted on the driver."""
    return _combined(df, channels, np.linalg.inv(np.array(spill, float)))


def decompensate(df: DataFrame, channels: list[str], spill: list[list[float]]) -> DataFrame:
    return _combined(df, channels, np.array(spill, float))


def parse_spill(text: str | None) -> tuple[list[str], list[list[float]]] | None:
    """Detectors and matrix of a spillover keyword (``n, names, n * n values``); None if there is none."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    if not parts or not parts[0].isdigit():
        return None
    n = int(parts[0])
    if len(parts) != 1 + n + n * n:
        raise ValueError("spillover keyword of unexpected length")
    values = [float(v) for v in parts[1 + n :]]
    return parts[1 : 1 + n], [values[i * n : (i + 1) * n] for i in range(n)]
