"""Exact top-k inner products by no-random-access aggregation (NRA).

Candidates are dealt into blocks of similar norm. In a block every dimension is a list sorted by value, which a query
reads from the end that suits its sign. What has been read bounds every candidate's score: unread parts are at least
their list's least contribution and at most the one at the present depth. Lists are read in rounds of growing depth, a
candidate whose upper bound is below the k-th best lower bound is out, and when few are left, or the lists end, final
scores are resolved. A block whose list heads add up to less than the bound is not read at all.

All queries of a group read to the same depth, so a round's bounds are two matrix products: a positive weight meets
the value or, if that is unread, the list's present one (upper bound) or last one (lower bound).

A first pass over one block of large norms gives every query a score that k candidates reach; the pass over all blocks
starts from there.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, scratch, table
from .graphs import grouped
from .vectors import matrix, take_part

#: Share of every list that has been read after each round.
ROUNDS = (0.2, 0.4, 0.55, 0.7, 0.85, 1.0)
#: Share of candidates below which the rest are resolved one by one.
FEW = 0.02
#: Candidates of a block at most, queries that travel together and that are searched together, classes of norms.
BLOCK, QUERY_GROUP, TILE, NORMS = 16_384, 1024, 256, 16


class SortedLists:
    """A block of candidates as one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.sort(self.rows, axis=0)
        self.first_round = 0  # where the last queries began to drop candidates

    def _exact_kind(self, queries: np.ndarray):
        """A type in which sums of products of these integers are exact."""
        most = np.abs(queries).max(initial=0).astype(float) * np.abs(self.rows).max(initial=0).astype(float) * self.rows.shape[1]
        return np.float32 if most < 2**24 else np.float64

    def top(self, q_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, places and scores of each query's k best, best first, ties to smaller ids.

        ``floor``: scores that k candidates are known to reach, or -inf; candidates below need not be returned. Rows of
        the query's own id are no candidates.
        """
        kind = self._exact_kind(queries)
        rows, lists = self.rows.astype(kind), self.lists.astype(kind)
        found = [self._tile(q_ids[at : at + TILE], queries[at : at + TILE].astype(kind), k, floor[at : at + TILE].astype(np.float64), rows, lists) for at in range(0, len(q_ids), TILE)]
        return tuple(np.concatenate([f[i] + (n * TILE if not i else 0) for n, f in enumerate(found)]) for i in range(3))

    def _tile(self, q_ids, queries, k, floor, rows, lists):
        m = len(rows)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        live = np.flatnonzero(up @ lists[-1] + down @ lists[0] >= floor)  # heads of the lists
        if not len(live):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        queries, up, down, floor, q_ids = queries[live], up[live], down[live], floor[live].copy(), q_ids[live]
        own = np.searchsorted(self.ids, q_ids, "right") - np.searchsorted(self.ids, q_ids, "left")
        alive = None
        for number in range(self.first_round, len(ROUNDS)):
            depth = int(np.ceil(m * ROUNDS[number]))
            if depth >= m:
                break
            high, low = lists[m - depth], lists[depth - 1]
            upper = up @ np.maximum(rows, high).T + down @ np.minimum(rows, low).T
            if np.isinf(floor).any() and m > k + own.max():
                lower = up @ np.where(rows >= high, rows, lists[0]).T + down @ np.where(rows <= low, rows, lists[-1]).T
                floor = np.maximum(floor, np.partition(lower, m - k - own.max(), axis=1)[:, m - k - own.max()])
            alive = upper >= floor[:, None]
            left = alive.mean()
            if left > 0.9:
                self.first_round = max(self.first_round, min(number + 1, len(ROUNDS) - 1))
            if left <= FEW:
                break
        else:
            depth = m
        if depth < m:
            query, place = np.nonzero(alive)
            score = np.concatenate([np.einsum("ij,ij->i", queries[query[a : a + 50_000]], rows[place[a : a + 50_000]]) for a in range(0, len(query), 50_000)] or [np.empty(0)])
        else:  # the lists have been read to their ends: bounds are scores
            whole = queries @ rows.T
            if m > k + own.max():
                floor = np.maximum(floor, np.partition(whole, m - k - own.max(), axis=1)[:, m - k - own.max()])
            query, place = np.nonzero(whole >= floor[:, None])
            score = whole[query, place]
        good = (score >= floor[query]) & (self.ids[place] != q_ids[query])
        query, place, score = query[good], place[good], score[good]
        order = np.lexsort((place, -score, query))  # ids ascend in a block
        query, place, score = query[order], place[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        return live[query[best]], place[best], score[best].astype(np.float64)


def _packed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """(name, id, v) -> a row per ``name`` with all its ids and vectors as bytes."""

    def pack(batches):
        for key, t in grouped(batches):
            ids, v = t.column("id").to_numpy(), matrix(t.column("v")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([ids.tobytes()]), pa.array([v.tobytes()])], names=[name, "ids", "data"])

    return df.repartition(parts, name).sortWithinPartitions(name, "id").mapInArrow(pack, f"{name} long, ids binary, data binary")


def _searched(batches, k: int, dims: int):
    """(block, part, ids, data, floor), a block's candidates (part -1) before the queries that ask it -> part, query_id, id, score."""
    index = block = None
    for batch in batches:
        for row in batch.to_pylist():
            ids, data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(-1, dims)
            if row["part"] < 0:
                index, block = SortedLists(ids, data), row["block"]
                continue
            if row["block"] != block:
                continue  # the hash left this block empty
            floor = np.full(len(ids), -np.inf)
            known = np.frombuffer(row["floor"] or b"", np.float64)
            floor[: len(known)] = known
            query, place, score = index.top(ids, data, k, floor)
            arrays = [pa.array(np.full(len(query), row["part"])), pa.array(query), pa.array(ids[query]), pa.array(index.ids[place]), pa.array(score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "number", "query_id", "id", "score"])


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The k highest integer inner products of every query with all other rows: query_id, rank, id, score.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by ``every``; all rows but
    those of the query's id are candidates; fewer candidates give fewer rows; ties go to the smaller id. Null ids,
    vectors that are null, empty or hold null or non-finite components, and those of an unusual dimension take no part.
    Repeated rows are candidates each. An empty table gives no rows. Vectors whose squared length (after scaling) reaches
    2^53 raise: their products could not be summed exactly.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        return materialize(_exact_top_k(vectors, id_col, vec_col, every, k, scale), "topk", keep=True)


def _exact_top_k(vectors: DataFrame, id_col: str, vec_col: str, every: int, k: int, scale: int) -> DataFrame:
    spark = vectors.sparkSession
    parts, cores = parallelism(spark), spark.sparkContext.defaultParallelism
    rows = take_part(vectors, id_col, vec_col, zero=True).select("id", F.transform("vec", lambda x: F.floor(x * scale)).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    rows = materialize(rows.withColumn("norm", norm), "topk-rows")
    shape = rows.agg(F.max(F.size("v")), F.percentile_approx("norm", [i / NORMS for i in range(1, NORMS)], F.lit(1000)), F.max("norm")).first()
    if shape[0] is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    if shape[2] >= 2.0**53:  # no product exceeds the largest square, so sums below are exact in doubles
        raise ValueError(f"vectors of a squared length of {shape[2]:g}: their scores can't be held exactly")
    dims, edges = shape[0], sorted(set(shape[1]))

    # blocks hold rows of one class of norms, the largest norms last; a class of many rows has many blocks
    level = sum((F.when(F.col("norm") > e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = rows.select("id", "v", level.alias("level"))
    sizes = dict(rows.groupBy("level").count().collect())  # NORMS rows at most
    most = max(1, min(BLOCK, -(-sum(sizes.values()) // (2 * cores))))
    counts = [-(-sizes.get(i, 0) // most) for i in range(len(edges) + 1)]
    ends = list(itertools.accumulate(counts))
    blocks = ends[-1]
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("level") + 1)
    block = pick([e - c for e, c in zip(ends, counts, strict=True)]) + F.pmod(F.xxhash64("id"), pick([max(1, c) for c in counts]))
    lists = materialize(_packed(rows.select(block.alias("block"), "id", "v"), "block", parts), "topk-blocks")
    groups = rows.where(F.col("id") % every == 0)
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-groups.count() // QUERY_GROUP))))
    groups = materialize(_packed(groups.select(part.alias("part"), "id", "v"), "part", parts), "topk-queries")

    candidates = lists.select("block", F.lit(-1).cast("long").alias("part"), "ids", "data", F.lit(None).cast("binary").alias("floor"))

    def searched(asked: DataFrame) -> DataFrame:
        met = candidates.unionByName(asked).repartitionById(min(parts, blocks), F.pmod("block", F.lit(min(parts, blocks))).cast("int"))
        return met.sortWithinPartitions("block", "part").mapInArrow(lambda b: _searched(b, k, dims), "part long, number long, query_id long, id long, score long")

    # what k candidates of one block of the largest norms reach
    ask_one = groups.select((F.lit(blocks - 1) - F.pmod("part", F.lit(max(1, counts[-1])))).cast("long").alias("block"), "part", "ids", "data", F.lit(None).cast("binary").alias("floor"))
    reached = searched(ask_one).groupBy("part", "number").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).repartition(parts, "part").sortWithinPartitions("part", "number")

    def floors(batches):
        for key, t in grouped(batches):
            number, value = t.column("number").to_numpy(), t.column("floor").to_numpy(zero_copy_only=False).astype(float)
            floor = np.full(int(number.max()) + 1, -np.inf)
            floor[number] = np.where(np.isnan(value), -np.inf, value)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([floor.tobytes()])], names=["part", "floor"])

    floor = materialize(reached.mapInArrow(floors, "part long, floor binary"), "topk-floors")
    # the stated query set meets all rows block by block
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = groups.join(floor, "part", "left").select(every_block, "part", "ids", "data", "floor")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = searched(asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
