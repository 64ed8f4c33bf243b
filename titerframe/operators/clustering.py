"""Clusterers of feature vectors behind one interface: self-organising map, neighbour-graph communities, density, k-means.

A clusterer is fitted on a table (id, vector) and gives a :class:`Fitted`: small tables that say everything about the
model, so that all kinds are saved, loaded and applied alike. Training tables that have to be compared pair by pair are
bounded (``max_training``, checked) and travel to the tasks as one matrix; rows to predict are of any number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .staging import staged, unstaged

BLOCK = 256
#: Rows that are scored at once.
SCORED = 10_000


class Clusterer(Protocol):
    """What a registered clusterer offers. It is made from its options; fitting it does not change it."""

    def fit(self, rows: DataFrame, id_col: str, vec_col: str) -> Fitted: ...


@dataclass
class Fitted:
    """A fitted clusterer: its kind, its options and its state as small tables."""

    kind: str
    options: dict[str, Any]
    tables: dict[str, pd.DataFrame]
    #: Cluster of every training row (id, cluster and, where the kind has it, outlier) in the order of their ids; empty
    #: where the training table is not bounded.
    labels: pd.DataFrame
    info: dict[str, Any] = field(default_factory=dict)

    def predict(self, rows: DataFrame, vec_col: str) -> DataFrame:
        """``rows`` with cluster (-1: noise), prob and outlier (null where the kind has none).

        Vectors that are null, hold null or not finite entries or are of another length than the training ones get nulls.
        """
        width, score = PREDICTORS[self.kind](self)
        at = rows.columns.index(vec_col)
        schema = StructType([*rows.schema.fields, StructField("cluster", IntegerType()), StructField("prob", DoubleType()), StructField("outlier", DoubleType())])

        def run(batches):
            for batch in batches:
                x, good = _matrix(batch.column(at), width)
                parts = [score(x[i : i + SCORED]) for i in range(0, len(x), SCORED)]
                columns = [np.concatenate([p[j] for p in parts]) if parts else np.empty(0) for j in range(3)]
                spread = np.full((3, batch.num_rows), np.nan)
                spread[:, good] = columns
                arrays = [pa.array(c, kind, from_pandas=True) for c, kind in zip((spread[0], spread[1], spread[2]), (pa.float64(),) * 3, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, arrays[0].cast(pa.int32()), *arrays[1:]], names=schema.names)

        return rows.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write all tables under ``path``, each as Parquet, with what is left as one row of JSON."""
        tables = self.tables | ({"labels": self.labels} if len(self.labels) else {})
        for name, df in tables.items():
            plain = df.apply(lambda c: c.map(lambda v: [float(x) for x in v]) if c.dtype == object else c).assign(__at=range(len(df)))
            spark.createDataFrame(plain).write.mode("overwrite").parquet(f"{path}/{name}")
        said = json.dumps({"kind": self.kind, "options": self.options, "info": self.info, "tables": sorted(tables)})
        spark.createDataFrame([(said,)], "said string").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        said = json.loads(spark.read.parquet(f"{path}/about").first().said)

        def read(name: str) -> pd.DataFrame:
            return spark.read.parquet(f"{path}/{name}").orderBy("__at").drop("__at").toPandas()

        tables = {n: read(n) for n in said["tables"]}
        labels = tables.pop("labels", pd.DataFrame({"id": [], "cluster": []}))
        return cls(said["kind"], said["options"], tables, labels, said["info"])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as a matrix, and which rows they are."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False).astype(bool)
    x = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    finite = np.isfinite(x).all(1)
    good[np.flatnonzero(good)[~finite]] = False
    return x[finite], good


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, dimension by dimension: the same whatever the block."""
    total, step = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for j in range(q.shape[1]):
        np.subtract(q[:, j, None], x[None, :, j], out=step)
        np.multiply(step, step, out=step)
        total += step
    return np.sqrt(total, out=total)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of every row, in order; ties to the smaller column. What a stable sort of all gives."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(d, near, 1)
    out = np.take_along_axis(near, np.argsort(values, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((d <= values.max(1)[:, None]).sum(1) > k)  # which of the equal ones came is open there
    out[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return out


class NearestRows:
    """The k nearest of a bounded matrix's rows for many others, as :func:`_smallest` of all :func:`_distances` gives them.

    Rows that ask are dealt to cells of a tree over the matrix. All rows of a cell meet those of the matrix that may be
    among the k nearest of any: as near to the cell's box as the k-th of its middle allows.
    """

    def __init__(self, x: np.ndarray, leaf: int = 12):
        self.x, self.splits = x, []

        def grow(rows: np.ndarray) -> int:
            spread = x[rows].max(0) - x[rows].min(0) if len(rows) and x.shape[1] else np.zeros(1)
            if len(rows) <= leaf or spread.max() == 0:
                return -1
            j = int(spread.argmax())
            cut = float(np.median(x[rows, j]))
            side = x[rows, j] > cut
            if not side.any():
                side = x[rows, j] >= cut
            if side.all() or not side.any():
                return -1
            me = len(self.splits)
            self.splits.append(None)
            self.splits[me] = (j, cut, grow(rows[~side]), grow(rows[side]))
            return me

        self.root = grow(np.arange(len(x)))

    def cells(self, q: np.ndarray) -> list[np.ndarray]:
        out, todo = [], [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out += [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
                continue
            j, cut, low, high = self.splits[node]
            side = q[rows, j] > cut
            todo += [(low, rows[~side]), (high, rows[side])]
        return out

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (rows of ``q`` by k) and distances."""
        k = min(k, len(self.x))
        at, d = np.empty((len(q), k), int), np.empty((len(q), k))
        for rows in self.cells(q):
            part = q[rows]
            low, high = part.min(0), part.max(0)
            middle = (low + high) / 2
            from_middle = _distances(middle[None], self.x)[0]
            reach = np.partition(from_middle, k - 1)[k - 1] + np.sqrt((((high - low) / 2) ** 2).sum())
            outside = np.maximum(np.maximum(low - self.x, self.x - high), 0.0)
            use = np.flatnonzero(~(np.sqrt((outside * outside).sum(1)) > reach * (1 + 1e-9)))
            some = _distances(part, self.x[use])
            near = _smallest(some, k)
            at[rows], d[rows] = use[near], np.take_along_axis(some, near, 1)
        return at, d


def usable_rows(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite vector of the most frequent length (of equally frequent ones the longest)."""
    good = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(F.col(vec_col).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    use = rows.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    common = use.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    return use.join(F.broadcast(common), F.size("vec") == F.col("d"), "left_semi")


def _collected(rows: DataFrame, id_col: str, vec_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the matrix of a training table whose size is checked."""
    use = usable_rows(rows, id_col, vec_col)
    n = use.count()
    if n > most:
        raise ValueError(f"{n} training rows; draw {most} of them first, or raise max_training")
    df = use.toPandas().sort_values("id", kind="stable")
    return df["id"].to_numpy(), np.stack(df["vec"].to_list()).astype(float) if n else np.empty((0, 0))


def _positions(spark: SparkSession, n: int) -> DataFrame:
    """Numbers of the training rows, a few per task."""
    return spark.range(0, n, 1, max(1, min(4 * spark.sparkContext.defaultParallelism, n // BLOCK + 1)))


def neighbour_graph(spark: SparkSession, x: np.ndarray, k: int) -> DataFrame:
    """The k nearest other rows of every row of a bounded matrix: a, b, d, by position; ties to the smaller position."""
    k = min(k, len(x) - 1)

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i in range(0, len(at), BLOCK):
                rows = at[i : i + BLOCK]
                d = _distances(x[rows], x)
                d[np.arange(len(rows)), rows] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, k)), pa.array(near.ravel()), pa.array(np.take_along_axis(d, near, 1).ravel())], names=["a", "b", "d"])

    return _positions(spark, len(x)).mapInArrow(run, "a long, b long, d double")


def _by_size(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered by falling size, of equal sizes by first row; negative ones stay."""
    names, first, counts = np.unique(labels, return_index=True, return_counts=True)
    order = sorted((i for i in range(len(names)) if names[i] >= 0), key=lambda i: (-counts[i], first[i]))
    new = {names[i]: k for k, i in enumerate(order)}
    return np.array([new.get(v, -1) for v in labels], int)


# ------------------------------------------------------------------------------------------------- self-organising map


def _summed(rows: DataFrame, width: int, f, length: int) -> np.ndarray:
    """Sum over all rows of ``f`` (matrix -> array of ``length``): a row per task, combined before the shuffle."""

    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            x, _ = _matrix(batch.column(0), width)
            for i in range(0, len(x), 4096):
                total += f(x[i : i + 4096])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, length], pa.int32()), pa.array(total))], names=["v"])

    out = np.zeros(length)
    for i, v in rows.select("vec").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def linkage_groups(x: np.ndarray, k: int) -> np.ndarray:
    """Average-linkage groups of a few rows, at most ``k``, numbered by their first row."""
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(len(x)), np.arange(len(x))
    for _ in range(len(x) - k):
        i, j = divmod(int(d.argmin()), len(x))
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        d[:, i][size == 0], d[i][size == 0] = np.inf, np.inf
        size[i], size[j] = size[i] + size[j], 0
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]


@dataclass
class SelfOrganisingMap:
    """Nodes on a grid that move to the mean of the rows near them on the grid, and groups of nodes as clusters.

    Batch training: in an epoch every row finds its nearest node (ties to the smaller), and nodes become means of all
    rows weighted by a Gaussian of the distance on the grid, whose width falls from half the grid to ``last_radius``. Only
    sums per node leave a task. The first codebook spans the two main axes of the rows, so nothing is random. Clusters are
    average-linkage groups of nodes (``label_kind`` metacluster) or the nodes.
    """

    width: int = 10
    height: int = 10
    epochs: int = 10
    n_clusters: int = 30
    last_radius: float = 0.5
    label_kind: str = "metacluster"

    def fit(self, rows: DataFrame, id_col: str, vec_col: str) -> Fitted:
        if self.label_kind not in ("cluster", "metacluster"):
            raise ValueError("label_kind is cluster or metacluster")
        use = staged(usable_rows(rows, id_col, vec_col), "som-rows")
        first = use.first()
        if first is None:
            raise ValueError("no vectors to fit a map on")
        d = len(first.vec)
        sums = _summed(use, d, lambda x: np.concatenate([[len(x)], x.sum(0)]), d + 1)
        mean = sums[1:] / sums[0]
        cov = _summed(use, d, lambda x: ((x - mean).T @ (x - mean)).ravel(), d * d).reshape(d, d) / sums[0]
        nodes = self.start(mean, cov)
        grid = np.array([(i // self.width, i % self.width) for i in range(len(nodes))], float)
        between = ((grid[:, None] - grid[None]) ** 2).sum(2)
        for epoch in range(self.epochs):
            counts = self._sums(use, nodes, d)
            near = np.exp(-between / (2.0 * self.radius(epoch) ** 2))
            weight = near @ counts[:, 0]
            moved = weight > 1e-300
            nodes[moved] = (near @ counts[:, 1:])[moved] / weight[moved, None]
        groups = linkage_groups(nodes, min(self.n_clusters, len(nodes))) if self.label_kind == "metacluster" else np.arange(len(nodes))
        table = pd.DataFrame({"node": np.arange(len(nodes)), "weights": list(nodes), "cluster": groups})
        fitted = Fitted("som", vars(self).copy(), {"nodes": table}, pd.DataFrame({"id": [], "cluster": []}))
        fitted.info["n"] = int(sums[0])
        unstaged(use)
        return fitted

    def start(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """The first codebook: a grid over two deviations both ways along the two main axes."""
        e, u = np.linalg.eigh(cov)
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(u))] < 0, -1.0, 1.0)  # a sign of its own for every axis
        axes = [u[:, -1 - i] * np.sqrt(max(e[-1 - i], 0.0)) if i < len(e) else np.zeros(len(mean)) for i in (0, 1)]
        across, down = (np.linspace(-2, 2, n) if n > 1 else np.zeros(1) for n in (self.width, self.height))
        return np.array([mean + a * axes[0] + b * axes[1] for b in down for a in across])

    def radius(self, epoch: int) -> float:
        largest = max(self.width, self.height) / 2.0
        return largest + (self.last_radius - largest) * (epoch / max(1, self.epochs - 1))

    def _sums(self, rows: DataFrame, nodes: np.ndarray, d: int) -> np.ndarray:
        k = len(nodes)

        def sums(x: np.ndarray) -> np.ndarray:
            nearest = np.concatenate([_distances(x[i : i + 512], nodes).argmin(1) for i in range(0, len(x), 512)])
            sums = [np.bincount(nearest, minlength=k), *(np.bincount(nearest, x[:, j], k) for j in range(d))]
            return np.stack(sums, 1).astype(float).ravel()

        return _summed(rows, d, sums, k * (d + 1)).reshape(k, d + 1)


def _nearest_of(fitted: Fitted):
    """Scores by the nearest of a table of points (columns weights, cluster)."""
    points = fitted.tables["nodes"]
    x, cluster = np.stack(points["weights"].to_list()).astype(float), points["cluster"].to_numpy(int)

    def score(q: np.ndarray):
        none = np.full(len(q), np.nan)
        nearest = np.concatenate([_distances(q[i : i + BLOCK], x).argmin(1) for i in range(0, len(q), BLOCK)])
        return cluster[nearest].astype(float), none, none

    return x.shape[1], score


@dataclass
class Means:
    """k-means by ``pyspark.ml``; the centres are the model."""

    k: int = 10
    seed: int = 1
    rounds: int = 20

    def fit(self, rows: DataFrame, id_col: str, vec_col: str) -> Fitted:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        use = staged(usable_rows(rows, id_col, vec_col).select("id", array_to_vector("vec").alias("features")), "means")
        centres = KMeans(k=self.k, seed=self.seed, maxIter=self.rounds).fit(use).clusterCenters()
        unstaged(use)
        table = pd.DataFrame({"node": np.arange(len(centres)), "weights": [np.asarray(c, float) for c in centres], "cluster": np.arange(len(centres))})
        return Fitted("kmeans", vars(self).copy(), {"nodes": table}, pd.DataFrame({"id": [], "cluster": []}))


# --------------------------------------------------------------------------------------------------------- communities


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (node, c) on undirected edges (a < b or a loop, w)."""
    a, b = (labels.select(F.col("node").alias(n), F.col("c").alias(f"c{n}")) for n in "ab")
    inside = F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)
    ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), inside.alias("inside")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside")))).alias("e")
    sums = edges.join(a, "a").join(b, "b").select("w", ends).groupBy("e.c").agg(F.sum("w").alias("k"), F.sum("e.inside").alias("inside"))
    shared, square, total = sums.agg(F.sum("inside"), F.sum(F.col("k") * F.col("k")), F.sum("k")).first()
    return 2.0 * shared / total - resolution * square / total**2 if total else 0.0


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 10) -> DataFrame:
    """Communities (node, c: a node's number) of an undirected weighted graph (a, b, w) by moves that raise modularity.

    In a round every node sums its links by neighbouring community and picks the one of the largest gain, by joins and
    groupings alone; half of the nodes, by hash of node and round, may then move, so that neighbours seldom swap. Rounds end
    when no node wishes to move. A level's communities are the next one's nodes, with summed links, until a level does not
    raise the modularity any more; that level is left out. Reruns agree.
    """
    level = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    total = level.agg(F.sum("w")).first()[0]
    members = staged(level.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.col("node")), "members")
    if not total:
        return members
    for depth in range(levels):
        both = level.where("a <> b").select("a", "b", "w").union(level.where("a <> b").select("b", "a", "w"))
        degree = level.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
        labels = staged(degree.withColumn("c", F.col("node")), "labels")
        started = modularity(level, labels, resolution)
        for r in range(rounds):
            sums = labels.groupBy("c").agg(F.sum("k").alias("all"))
            near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("in"))
            own = labels.select("node", "c", F.lit(0.0).alias("in"))
            options = near.unionByName(own).groupBy("node", "c").agg(F.sum("in").alias("in")).join(sums, "c")
            options = options.join(labels.select("node", "k", F.col("c").alias("was")), "node")
            stay = F.col("c") == F.col("was")
            gain = F.col("in") - resolution * F.col("k") * (F.col("all") - F.when(stay, F.col("k")).otherwise(0.0)) / (2.0 * total)
            picked = options.groupBy("node", "k", "was").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), stay.alias("stay"), (-F.col("c")).alias("minus"))).alias("top"))
            may = F.pmod(F.xxhash64("node", F.lit(1000 * depth + r)), F.lit(2)) == 0
            wish = Observation()
            picked = picked.observe(wish, F.count_if(-F.col("top.minus") != F.col("was")).alias("moves"))
            new = staged(picked.select("node", "k", F.when(may, -F.col("top.minus")).otherwise(F.col("was")).alias("c")), "labels")
            unstaged(labels)
            labels = new
            if not wish.get["moves"]:
                break
        best = labels
        if modularity(level, best, resolution) <= started + 1e-9:
            unstaged(best)
            break
        names = best.select(F.col("node").alias("c"), F.col("c").alias("to"))
        grown = staged(members.join(names, "c").select("node", F.col("to").alias("c")), "members")
        a, b = (best.select(F.col("node").alias(n), F.col("c").alias(f"c{n}")) for n in "ab")
        merged = level.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        merged = staged(merged, "links")
        unstaged(members, level, best)
        members, level = grown, merged
    unstaged(level)
    return members


@dataclass
class NeighbourCommunities:
    """Communities of a pruned neighbour graph.

    Links of a row to its ``knn`` nearest that are longer than its mean plus ``dist_std_local`` deviations go; of the rest,
    those stay whose ends share more neighbours (Jaccard) than the median link's, weighted by that share. Communities above
    ``too_big_factor`` of all rows are clustered once more by themselves; rows of those below ``small_pop`` join the
    community of most of their neighbours. New rows take the vote of their nearest training rows.
    """

    knn: int = 30
    dist_std_local: float = 3.0
    too_big_factor: float = 0.4
    small_pop: int = 10
    resolution: float = 1.0
    prediction_k: int | None = None
    max_training: int = 100_000

    def fit(self, rows: DataFrame, id_col: str, vec_col: str) -> Fitted:
        spark = rows.sparkSession
        ids, x = _collected(rows, id_col, vec_col, self.max_training)
        if len(x) < 2:
            raise ValueError("communities need two rows at least")
        labels = self.labelled(spark, x)
        big = [c for c, n in zip(*np.unique(labels, return_counts=True), strict=True) if n > self.too_big_factor * len(x)]
        for c in big if len(np.unique(labels)) > 1 else []:
            at = np.flatnonzero(labels == c)
            labels[at] = labels.max() + 1 + self.labelled(spark, x[at])
        labels = _by_size(self._joined(spark, x, labels))
        table = pd.DataFrame({"vec": list(x), "cluster": labels})
        return Fitted("communities", vars(self).copy(), {"training": table}, pd.DataFrame({"id": ids, "cluster": labels}), {"n": len(x)})

    def labelled(self, spark: SparkSession, x: np.ndarray) -> np.ndarray:
        near = staged(neighbour_graph(spark, x, self.knn), "neighbours")
        limits = near.groupBy("a").agg((F.avg("d") + self.dist_std_local * F.stddev_pop("d")).alias("most"))
        short = near.join(limits, "a").where("d <= most")
        links = staged(short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sets = both.groupBy("a").agg(F.collect_set("b").alias("s"))
        j = links.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("s").alias("t")), "b")
        shared = F.size(F.array_intersect("s", "t"))
        shares = staged(j.select("a", "b", (shared / (F.size("s") + F.size("t") - shared)).alias("w")), "shares")
        median = shares.agg(F.percentile("w", 0.5)).first()[0]  # links of a bounded training table
        kept = shares.where(F.col("w") > median)
        if not kept.limit(1).count():  # all alike: nothing to prune by
            kept = shares.where("w > 0")
        found = communities(kept, self.resolution)
        labels = np.arange(len(x))  # rows without a link are alone
        for node, c in found.collect():  # a row per training row
            labels[node] = c
        unstaged(near, links, shares, found)
        return np.unique(labels, return_inverse=True)[1]

    def _joined(self, spark: SparkSession, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Rows of small communities by the vote of their neighbours in others; rounds until none is left or none moves."""
        near = neighbour_graph(spark, x, self.knn).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("n"))
        lists = None
        for _ in range(20):
            names, counts = np.unique(labels, return_counts=True)
            small = np.isin(labels, names[counts < self.small_pop])
            if not small.any() or small.all():
                break
            if lists is None:
                lists = {r.a: [p.b for p in r.n] for r in near.collect()}
            new = labels.copy()
            for i in np.flatnonzero(small):
                votes = [labels[j] for j in lists[i] if not small[j]]
                if votes:
                    values, n = np.unique(votes, return_counts=True)
                    new[i] = values[n.argmax()]
            if (new == labels).all():
                break
            labels = new
        return labels


def _voted(fitted: Fitted):
    """Scores by the vote of the nearest training rows; equal votes go to the smaller label."""
    training = fitted.tables["training"]
    x, y = np.stack(training["vec"].to_list()).astype(float), training["cluster"].to_numpy(int)
    k = min(len(x), fitted.options["prediction_k"] or fitted.options["knn"])
    tree = NearestRows(x)

    def score(q: np.ndarray):
        near, width = tree.nearest(q, k)[0], y.max() + 2
        votes = np.bincount((np.arange(len(q))[:, None] * width + y[near]).ravel(), minlength=len(q) * width).reshape(len(q), width).astype(float)
        share = votes.max(1) / k
        return votes.argmax(1).astype(float), share, 1.0 - share

    return x.shape[1], score


# ------------------------------------------------------------------------------------------------------------- density


def core_distances(spark: SparkSession, x: np.ndarray, k: int) -> np.ndarray:
    """Distance of every row to its k-th nearest other row (to the farthest one, if there are fewer)."""
    out = np.zeros(len(x))
    for a, d in neighbour_graph(spark, x, k).groupBy("a").agg(F.max("d").alias("d")).collect():  # a row per training row
        out[a] = d
    return out


def spanning_tree(spark: SparkSession, x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (weight, a, b) of the minimum spanning tree of mutual reachability, by weight and ends.

    Boruvka's rounds: every row finds its nearest row of another component, in blocks against the whole bounded matrix, so
    the tree is exact; components take the least of their rows' edges and merge. There are at least half as many
    components after a round.
    """
    part, edges = np.arange(len(x)), []
    while len(np.unique(part)) > 1:

        def run(batches, part=part):
            for batch in batches:
                at = batch.column(0).to_numpy()
                for i in range(0, len(at), BLOCK):
                    rows = at[i : i + BLOCK]
                    w = np.maximum(np.maximum(_distances(x[rows], x), core[None]), core[rows, None])
                    w[part[rows, None] == part[None]] = np.inf
                    to = w.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(w[np.arange(len(rows)), to]), pa.array(np.minimum(rows, to)), pa.array(np.maximum(rows, to))], names=["part", "w", "a", "b"])

        least = _positions(spark, len(x)).mapInArrow(run, "part long, w double, a long, b long").groupBy("part").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct()
        for w, a, b in sorted(map(tuple, least.collect())):  # a row per component
            if part[a] != part[b]:
                edges.append((w, a, b))
                part = np.where(part == max(part[a], part[b]), min(part[a], part[b]), part)
    return np.array(sorted(edges)).reshape(-1, 3)


@dataclass
class Tree:
    """A condensed cluster tree: per row the cluster it falls out of and at which density, per cluster its parent and birth."""

    cluster: np.ndarray
    density: np.ndarray
    parent: np.ndarray
    birth: np.ndarray
    size: np.ndarray

    def most(self) -> np.ndarray:
        """Largest density at which a row or a child leaves the cluster."""
        out = np.zeros(len(self.parent))
        np.maximum.at(out, self.cluster, self.density)
        np.maximum.at(out, self.parent[1:], self.birth[1:])
        return out

    def most_below(self) -> np.ndarray:
        """The same over a cluster and all below it."""
        out = self.most()
        for c in range(len(out) - 1, 0, -1):  # children come after their parents
            out[self.parent[c]] = max(out[self.parent[c]], out[c])
        return out

    def selected(self, method: str) -> np.ndarray:
        """Which clusters stand: those without children, or those of most excess of mass. Never the root."""
        n = len(self.parent)
        leaf = np.ones(n, bool)
        leaf[self.parent[1:]] = False
        if method == "leaf":
            chosen = leaf.copy()
        elif method == "eom":
            finite = np.where(np.isfinite(self.density), self.density, np.nanmax(np.where(np.isfinite(self.density), self.density, np.nan), initial=0.0))
            mass = np.bincount(self.cluster, finite - self.birth[self.cluster], n)
            np.add.at(mass, self.parent[1:], (self.birth[1:] - self.birth[self.parent[1:]]) * self.size[1:])
            chosen, below = np.zeros(n, bool), np.zeros(n)
            for c in range(n - 1, 0, -1):
                chosen[c] = leaf[c] or mass[c] >= below[c]
                below[self.parent[c]] += max(mass[c], below[c])
            under = np.zeros(n, bool)  # what stands under a cluster that stands does not
            for c in range(1, n):
                above = self.parent[c]
                under[c] = above > 0 and (under[above] or chosen[above])
            chosen &= ~under
        else:
            raise ValueError("cluster_selection_method is leaf or eom")
        chosen[0] = False
        return chosen

    def owner(self, chosen: np.ndarray) -> np.ndarray:
        """For every cluster the standing one that it is or is under, or -1."""
        out = np.full(len(self.parent), -1)
        for c in range(1, len(out)):
            out[c] = c if chosen[c] else out[self.parent[c]]
        return out


def condensed(edges: np.ndarray, n: int, least: int) -> Tree:
    """The tree of a spanning tree's components as the allowed distance falls, without splits into parts below ``least`` rows.

    A part that is too small leaves its cluster row by row at the density (1 / distance) of the split; two parts or more
    that are large enough are new clusters. Edges of equal weight go at once, so their order does not matter.
    """
    up = np.arange(2 * n - 1)
    left, right, size = (np.zeros(2 * n - 1, int) for _ in range(3))
    size[:n], height = 1, np.zeros(2 * n - 1)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        a, b, new = top(int(a)), top(int(b)), n + k
        left[new], right[new], height[new], size[new] = a, b, w, size[a] + size[b]
        up[a] = up[b] = new

    def below(node: int, cut) -> list[int]:
        """Parts under a node once ``cut`` says that it splits."""
        out, todo = [], [node]
        while todo:
            i = todo.pop()
            if i >= n and cut(i):
                todo += [right[i], left[i]]
            else:
                out.append(i)
        return out

    cluster, density = np.zeros(n, int), np.zeros(n)
    parent, birth, sizes = [0], [0.0], [n]
    todo = [(2 * n - 2, 0)] if n > 1 else []
    for node, c in todo:  # grows as clusters are born, so that children come after their parents
        while True:
            rate = 1.0 / height[node] if height[node] > 0 else np.inf
            parts = below(node, lambda i, h=height[node]: height[i] == h)
            large = [p for p in parts if size[p] >= least]
            for p in parts:
                if size[p] < least:
                    rows = below(p, lambda i: True)
                    cluster[rows], density[rows] = c, rate
            if len(large) != 1:
                break
            node = large[0]
        for p in large:
            parent.append(c)
            birth.append(rate)
            sizes.append(int(size[p]))
            todo.append((p, len(parent) - 1))
    return Tree(cluster, density, np.array(parent), np.array(birth), np.array(sizes))


@dataclass
class DensityClusters:
    """Clusters of high density at any level (hierarchical, with noise), by a spanning tree of mutual reachability.

    Where more than ``max_noise`` of the rows are noise, smaller clusters are tried, each time 1.5 times smaller, at most
    ``max_refits`` times; the tree of the rows stays the same, and the clusters of least noise are kept. New rows go by
    their nearest training row in mutual reachability.
    """

    min_cluster_size: int = 15
    min_samples: int | None = 10
    max_noise: float = 0.15
    max_refits: int = 4
    cluster_selection_method: str = "leaf"
    max_training: int = 50_000

    def fit(self, rows: DataFrame, id_col: str, vec_col: str) -> Fitted:
        spark = rows.sparkSession
        ids, x = _collected(rows, id_col, vec_col, self.max_training)
        if not 2 <= self.min_cluster_size <= len(x):
            raise ValueError(f"min_cluster_size must be between 2 and the number of rows, {len(x)}")
        if not 0 <= self.max_noise <= 1:
            raise ValueError("max_noise must be between 0 and 1")
        core = core_distances(spark, x, self.min_samples or self.min_cluster_size)
        edges = spanning_tree(spark, x, core)
        size, history, best = self.min_cluster_size, [], None
        for _ in range(self.max_refits + 1):
            tree = condensed(edges, len(x), size)
            owner = tree.owner(tree.selected(self.cluster_selection_method))
            noise = float((owner[tree.cluster] < 0).mean())
            history.append({"min_cluster_size": size, "frac_noise": noise})
            if best is None or noise < best[0]:
                best = noise, size, tree, owner
            if best[0] <= self.max_noise or size <= 2:
                break
            size = max(2, min(size - 1, int(size / 1.5)))
        noise, size, tree, owner = best
        below = tree.most_below()[tree.cluster]
        with np.errstate(invalid="ignore", divide="ignore"):
            outlier = np.where((below > 0) & np.isfinite(tree.density) & np.isfinite(below), (below - tree.density) / below, 0.0)
            outlier = np.where(np.isfinite(tree.density) & np.isinf(below), 1.0, outlier)
        names = np.full(len(owner) + 1, -1)  # the last one for no owner
        names[np.unique(owner[owner >= 0])] = np.arange(len(np.unique(owner[owner >= 0])))
        label = names[owner]
        points = pd.DataFrame({"vec": list(x), "core": core, "branch": tree.cluster, "density": tree.density})
        branches = pd.DataFrame({"parent": tree.parent, "birth": tree.birth, "cluster": label, "most": tree.most()[owner] * (owner >= 0), "most_below": tree.most_below()})
        info = {"n": len(x), "history": history, "min_cluster_size": size, "frac_noise": noise, "noise_target_met": noise <= self.max_noise}
        return Fitted("density", vars(self).copy(), {"points": points, "branches": branches}, pd.DataFrame({"id": ids, "cluster": label[tree.cluster], "outlier": outlier}), info)


def _reached(fitted: Fitted):
    """Scores by the nearest training row in mutual reachability: its branch, at the density at which the new row joins."""
    points, branches = fitted.tables["points"], fitted.tables["branches"]
    x, core, branch, density = np.stack(points["vec"].to_list()).astype(float), points["core"].to_numpy(float), points["branch"].to_numpy(int), points["density"].to_numpy(float)
    parent, birth, label, most, below = (branches[c].to_numpy() for c in ("parent", "birth", "cluster", "most", "most_below"))
    samples = min(fitted.options["min_samples"] or fitted.info["min_cluster_size"], len(x) - 1)
    tree = NearestRows(x)

    def score(q: np.ndarray):
        near, dist = tree.nearest(q, 2 * samples + 1)
        reach = np.maximum(np.maximum(dist, core[near]), dist[:, samples, None])
        pick = reach.argmin(1)
        to, r = near[np.arange(len(q)), pick], reach[np.arange(len(q)), pick]
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(r > 0, 1.0 / r, np.inf)
            c = branch[to].copy()
            climbing = density[to] > rate  # its neighbour stays longer: the branch may be born after the row has left
            while (go := climbing & (c > 0) & (birth[c] >= rate)).any():
                c[go] = parent[c[go]]
            found = label[c].astype(float)
            prob = np.where(found < 0, 0.0, np.where(most[c] > 0, np.where(np.isinf(rate), 1.0, np.minimum(rate, most[c]) / most[c]), 1.0))
            last = below[branch[to]]
            outlier = np.where(last > 0, np.where(np.isinf(last), np.isfinite(rate) * 1.0, np.maximum(0.0, (last - rate) / last)), 0.0)
        return found, np.nan_to_num(prob), np.where(np.isinf(rate), 0.0, outlier)

    return x.shape[1], score


#: Clusterers by name; :func:`register` adds more. Predictors give a vector's length and a function of a matrix.
CLUSTERERS: dict[str, type] = {"som": SelfOrganisingMap, "kmeans": Means, "communities": NeighbourCommunities, "density": DensityClusters}
PREDICTORS = {"som": _nearest_of, "kmeans": _nearest_of, "communities": _voted, "density": _reached}


def register(name: str, clusterer: type, predictor) -> None:
    """Make a clusterer known under a name, with the function that predicts from what its ``fit`` returns."""
    CLUSTERERS[name], PREDICTORS[name] = clusterer, predictor


def clusterer(name: str, **options) -> Clusterer:
    if name not in CLUSTERERS:
        raise KeyError(f"no clusterer {name}; there are {sorted(CLUSTERERS)}")
    return CLUSTERERS[name](**options)
