"""Approximate nearest neighbours: an NN-descent graph built by joins, and greedy search on it.

Equal vectors are one node. A forest of splitting trees, grown on a bounded sample, deals nodes into small cells whose
all-pairs give a first graph. NN-descent improves it: around every node its neighbours, in both directions, meet and
compare with each other, and keep whom they did not know to be near. Queries walk the graph from their own node: the
nearest nodes not yet expanded are joined to their neighbours until no query improves. An exact check follows: what a
query has found bounds its distances, and cells around pivots that may hold something nearer are measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, remove_scratch, scratch, table
from .graphs import grouped
from .vectors import matrix, packed, take_part

#: Neighbours of a node, trees, nodes that meet in a cell or around a node, rounds, and width and depth of a search.
DEGREE, TREES, CELL, ROUNDS, WIDTH, HOPS = 16, 4, 192, 4, 48, 6
#: Vectors that trees are grown on.
SAMPLE = 8192
#: Pivots of the exact check at most, nodes of a cell's block, and nodes for which there is a pivot.
PIVOTS, BLOCK, PER_PIVOT = 1024, 4096, 256
#: Share of all links below which new ones end the descent.
ENOUGH = 0.01


class SplitTree:
    """Splits by the bisector of two random sample vectors; a leaf holds about ``leaf`` sample vectors."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normal, self.offset, self.child = [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf:
                self.leaves += 1
                return -self.leaves
            for _ in range(8):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                side = sample[rows] @ (a - b) - ((a @ a) - (b @ b)) / 2 > 0
                if 0.05 < side.mean() < 0.95:
                    break
            else:
                side = np.arange(len(rows)) % 2 == 0
                if (sample[rows] == sample[rows[0]]).all():
                    self.leaves += 1
                    return -self.leaves
            me = len(self.normal)
            self.normal.append(a - b)
            self.offset.append(((a @ a) - (b @ b)) / 2)
            self.child.append(None)
            self.child[me] = (grow(rows[~side]), grow(rows[side]))
            return me

        self.root = grow(np.arange(len(sample)))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0 or not len(rows):
                out[rows] = -node
                continue
            side = x[rows] @ self.normal[node] > self.offset[node]
            stack += [(self.child[node][0], rows[~side]), (self.child[node][1], rows[side])]
        return out


def _links(a, b, d):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64()), pa.array(np.concatenate(d) if d else [], pa.float32())], names=["a", "b", "d"])


def _met(batches, keys: int, most: int):
    """(key..., node, far, vec) sorted by key -> links (a, b, d) to the nearest of those met, if nearer than a's far."""
    a, b, d, held = [], [], [], 0
    for _, t in grouped(batches, keys):
        node, far = t.column("node").to_numpy(), t.column("far").to_numpy()
        node, first = np.unique(node, return_index=True)
        if len(node) < 2:
            continue
        far, x = far[first], packed(t.column("vec"), np.float32)[first]
        x = x - x.mean(0)  # products of what is far from zero would lose the differences
        square = (x * x).sum(1)
        dist = np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0)
        np.fill_diagonal(dist, np.inf)
        k = min(most, len(node) - 1)
        near = np.argpartition(dist, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(dist, near, 1)
        row, col = np.nonzero(value < far[:, None])
        a.append(node[row])
        b.append(node[near[row, col]])
        d.append(value[row, col])
        held += len(row)
        if held > 50_000:
            yield _links(a, b, d)
            a, b, d, held = [], [], [], 0
    yield _links(a, b, d)


def _nearest(links: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of every node: a, b, d."""
    # a hub's links are cut down before they move: the rank's limit is applied in every partition first
    ranked = links.withColumn("__r", F.dense_rank().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("__r") <= degree)
    return ranked.groupBy("a", "b").agg(F.min("d").alias("d"))


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """NN-descent graph (a, b, squared distance d) of ``nodes`` (node, vec as float32 bytes)."""
    spark = nodes.sparkSession
    parts = parallelism(spark)
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "a long, b long, d float")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()  # a bounded sample
    x = np.frombuffer(b"".join(sample["vec"]), np.float32).reshape(len(sample), -1)
    trees = [SplitTree(x, max(2, int(len(x) * CELL / 2 / max(1, n))) if n > CELL else len(x), seed + i) for i in range(TREES)]

    def cells(batches):
        for batch in batches:
            v = packed(batch.column("vec"), np.float32)
            for i, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(tree.leaf_of(v)), *batch.columns], names=["tree", "leaf", "node", "vec"])

    leaves = materialize(nodes.mapInArrow(cells, "tree long, leaf long, node long, vec binary"), "leaves")
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    cell = F.pmod(F.xxhash64("node", "tree"), F.col("cells")).alias("cell")
    met = leaves.join(sizes, ["tree", "leaf"]).select("tree", "leaf", cell, "node", F.lit(float("inf")).cast("float").alias("far"), "vec")
    links = met.repartition(parts, "tree", "leaf", "cell").sortWithinPartitions("tree", "leaf", "cell").mapInArrow(lambda b: _met(b, 3, degree), "a long, b long, d float")
    graph = materialize(_nearest(links, degree), "graph")
    remove_scratch(leaves)

    for _ in range(rounds):
        far = graph.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).cast("float").alias("far"))
        known = nodes.join(far, nodes.node == far.a, "left").select("node", F.coalesce("far", F.lit(float("inf")).cast("float")).alias("far"), "vec")
        both = graph.select(F.col("a").alias("at"), F.col("b").alias("node")).union(graph.select(F.col("b").alias("at"), F.col("a").alias("node"))).distinct()
        # around a hub its neighbours meet in several groups
        crowd = both.groupBy("at").agg(F.ceil(F.count("*") / (4 * degree)).alias("groups"))
        both = both.join(crowd, "at").select("at", F.pmod(F.xxhash64("node", "at"), F.col("groups")).alias("cell"), "node")
        met = both.join(known, "node").select("at", "cell", "node", "far", "vec")
        new = met.repartition(parts, "at", "cell").sortWithinPartitions("at", "cell").mapInArrow(lambda b: _met(b, 2, degree // 2), "a long, b long, d float")
        new = materialize(new.distinct(), "new-links")
        better = materialize(_nearest(graph.union(new), degree), "graph")
        gained = new.join(better, ["a", "b"], "left_semi").join(graph.select("a", "b"), ["a", "b"], "left_anti").count()
        for old in (graph, new):
            remove_scratch(old)
        graph = better
        if gained < ENOUGH * n * degree:
            break
    return graph


def search_nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, degree: int = DEGREE, rounds: int = ROUNDS, width: int = WIDTH, hops: int = HOPS) -> DataFrame:
    """Each query's k nearest rows found, by Euclidean distance: query_id, rank, id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own; fewer
    candidates give fewer rows; ties go to the smaller id. Every row is in the index. Null ids, vectors that are null,
    empty, all zero or hold null or non-finite components, and those of an unusual dimension take no part. Equal
    vectors share a node and are all candidates. An empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        return materialize(_search_nearest(vectors, id_col, vec_col, every, k, degree, rounds, width, hops), "nearest", keep=True)


def _search_nearest(vectors: DataFrame, id_col: str, vec_col: str, every: int, k: int, degree: int, rounds: int, width: int, hops: int) -> DataFrame:
    rows = materialize(take_part(vectors, id_col, vec_col), "ann-rows")
    copies = Window.partitionBy("vec").orderBy("id")
    # of equal vectors a result can hold k, and one more if the query is among them
    first = rows.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    first = first.withColumn("node", F.min("id").over(Window.partitionBy("vec")))
    first = materialize(first.select("node", "id", "vec"), "ann-copies")
    alone = first.where("node = id").select("node", "vec")

    pivots = alone.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("vec").toPandas()["vec"]  # a bounded sample
    pivots = np.stack(pivots.to_list()).astype(float) if len(pivots) else np.empty((0, 0))
    # the graph is built on centred vectors, one scale for all nodes
    centre = pivots.mean(0) if len(pivots) else 0.0
    most = alone.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    factor = 1.0 / most if most else 1.0

    def single(batches):
        for b in batches:
            v = (matrix(b.column("vec")) - centre) * factor if b.num_rows else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary())], names=["node", "vec"])

    nodes = materialize(alone.mapInArrow(single, "node long, vec binary"), "ann-nodes")
    graph = neighbour_graph(nodes, degree, rounds)
    roads = materialize(graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "roads")

    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    queries = materialize(queries, "ann-queries")

    def measured(batches):
        for b in batches:
            x, y = matrix(b.column("q")), matrix(b.column("vec"))
            d = np.sqrt(((x - y) ** 2).sum(1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("node"), pa.array(d, pa.float64())], names=["query_id", "node", "d"])

    def reach(pairs: DataFrame) -> DataFrame:
        near = pairs.join(alone, "node").join(queries, "query_id").select("query_id", "node", "q", "vec")
        return near.mapInArrow(measured, "query_id long, node long, d double")

    nearest = Window.partitionBy("query_id").orderBy("d", "node")
    # a query starts at the node of its own vector
    start = queries.join(alone.withColumnRenamed("vec", "q"), "q").select("query_id", "node", F.lit(0.0).alias("d"))
    beam = materialize(start.withColumn("open", F.lit(True)), "beam")
    for _ in range(hops):
        front = beam.where("open")
        seen = beam.select("query_id", "node")
        step = front.join(roads, front.node == roads.a).select("query_id", F.col("b").alias("node")).distinct().join(seen, ["query_id", "node"], "left_anti")
        fresh = reach(step).withColumn("open", F.lit(True))
        merged = beam.withColumn("open", F.lit(False)).union(fresh)
        merged = merged.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= width).drop("r")
        merged = materialize(merged, "beam")
        remove_scratch(beam)
        beam = merged
        if not beam.where("open").limit(1).count():
            break
    beam = _checked(alone, queries, beam, pivots[: max(1, nodes.count() // PER_PIVOT)], k + 1)
    found = beam.select("query_id", "node", "d").join(first.select("node", "id"), "node").where("query_id <> id")
    best = Window.partitionBy("query_id").orderBy("d", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), F.col("d").alias("score"))


def _checked(alone: DataFrame, queries: DataFrame, found: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(query_id, node, d): every query's ``k`` nearest of all nodes, from those it found.

    A node belongs to the cell of its nearest pivot; cells are cut into blocks. What the k-th node found is away bounds a
    query's distances, so it meets only blocks that the triangle inequality leaves open. Products choose the nodes that
    are measured, with room for their rounding.
    """
    parts = parallelism(alone.sparkSession)

    def away(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(pivots)))
        for i, p in enumerate(pivots):
            out[:, i] = np.sqrt(((x - p) ** 2).sum(1))
        return out

    def celled(batches):
        for b in batches:
            if b.num_rows:
                d = away(matrix(b.column("vec")))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), b.column("node"), b.column("vec"), pa.array(d[np.arange(len(d)), near])], names=["cell", "node", "vec", "off"])

    cells = materialize(alone.mapInArrow(celled, "cell long, node long, vec array<double>, off double"), "ann-cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.max("off").alias("radius"))
    known = sizes.toPandas()  # a row per pivot at most
    cell, blocks, radius = known["cell"].to_numpy(int), known["blocks"].to_numpy(int), known["radius"].to_numpy(float)
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    cells = cells.join(F.broadcast(sizes.select("cell", "blocks")), "cell").select("cell", place, F.lit(0).cast("long").alias("turn"), "node", "vec", F.lit(0.0).alias("bound"))

    r = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node"))
    bound = found.withColumn("r", r).where(F.col("r") == k).select("query_id", F.col("d").alias("bound"))
    asked = queries.join(bound, "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def dealt(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                limit = part.column("bound").to_numpy()
                d = away(matrix(part.column("q")))[:, cell]
                # not >, so that what overflowed is met
                row, i = np.nonzero(~(d - radius > limit[:, None] + 1e-9 * (d + radius)))
                times = blocks[i]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, i = np.repeat(row, times), np.repeat(i, times)
                for lo in range(0, len(row), 8192):
                    take = pa.array(row[lo : lo + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[i[lo : lo + 8192]], pa.int64()), pa.array(block[lo : lo + 8192], pa.int64()), part.column("query_id").take(take), part.column("q").take(take), part.column("bound").take(take)], names=["cell", "block", "node", "vec", "bound"])

    asks = asked.mapInArrow(dealt, "cell long, block long, node long, vec array<double>, bound double")
    # a block's nodes come first, then the queries by turns, so that no task holds them all
    asks = asks.withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(queries.count() // BLOCK + 1)) + 1)

    def nearer(batches):
        for (*_, turn), of in grouped(batches, 3):
            if not turn:
                exact_x, node = matrix(of.column("vec")), of.column("node").to_numpy()
                middle = exact_x.mean(0)
                x = exact_x - middle
                square = (x * x).sum(1)
                continue
            for lo in range(0, of.num_rows, 256):
                some = of.slice(lo, 256)
                exact_q, limit = matrix(some.column("vec")), some.column("bound").to_numpy()
                q = exact_q - middle
                own = (q * q).sum(1)
                about = own[:, None] + square[None] - 2 * (q @ x.T)
                room = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (own[:, None] + square[None])
                m = min(k, len(node))
                upto = np.minimum(limit**2 * (1 + 1e-9), np.partition(about + room, m - 1, axis=1)[:, m - 1])
                row, col = np.nonzero(~(about - room > upto[:, None]))
                ids = some.column("node").to_numpy()
                d = np.concatenate([np.sqrt(((exact_q[row[i : i + 4096]] - exact_x[col[i : i + 4096]]) ** 2).sum(1)) for i in range(0, len(row), 4096)]) if len(row) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(node[col], pa.int64()), pa.array(d, pa.float64())], names=["query_id", "node", "d"])

    met = cells.unionByName(asks).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "turn")
    near = met.mapInArrow(nearer, "query_id long, node long, d double")
    return near.withColumn("r", r).where(F.col("r") <= k).drop("r")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_nearest(table(spark, sf_dir, "embeddings"))
