"""Mixture models, marker calibration, cluster labelling and neighbour votes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged, unstaged
from .statistics import exact_quantiles

#: Rows of a part that k-means reads in every round at most, about.
ROWS_OF_A_PART = 500_000
#: Rows of parts whose mixtures are fitted together, about: as much as a core's cache holds.
TOGETHER = 20_000


Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit_mixture(x: np.ndarray, k: int, rounds: int = 100, tol: float = 1e-4, reg: float = 1e-6, tied: bool = False) -> Mixture:
    """Weights, means (k, d) and covariances (k, d, d) of a Gaussian mixture by EM.

    Starts from quantile groups along the first principal axis, so that a fit has no randomness; components are
    ordered by their first mean. ``tied`` components share one covariance.
    """
    return fit_mixtures([x], k, rounds, tol, reg, tied)[0]


def fit_mixtures(parts: list[np.ndarray], k: int, rounds: int = 100, tol: float = 1e-4, reg: float = 1e-6, tied: bool = False) -> list[Mixture]:
    """:func:`fit_mixture` of many small parts, each for itself; parts of similar size take their rounds together."""
    out: list[Mixture] = [None] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    at = 0
    while at < len(order):
        longest, end = len(parts[order[at]]), at + 1
        while end < len(order) and (end - at + 1) * longest <= TOGETHER and 4 * len(parts[order[end]]) >= 3 * longest:
            end += 1
        for i, model in zip(order[at:end], _fit_together([parts[i] for i in order[at:end]], k, rounds, tol, reg, tied), strict=True):
            out[i] = model
        at = end
    return out


def _fit_together(parts: list[np.ndarray], k: int, rounds: int, tol: float, reg: float, tied: bool) -> list[Mixture]:
    parts = [np.atleast_2d(x.astype(float).T).T for x in parts]
    d, sizes = parts[0].shape[1], np.array([len(x) for x in parts])
    up = np.triu_indices(d)
    # sums and densities are products with the moments of every row, about the mean; a shorter part ends in zeros
    moments = np.zeros((len(parts), 1 + d + len(up[0]), sizes.max()))
    resp = np.zeros((len(parts), k, sizes.max()))
    middle = np.stack([x.mean(0) for x in parts])
    for i, (x, n) in enumerate(zip(parts, sizes, strict=True)):
        centred = x - middle[i]
        axis = np.linalg.svd(centred[:: max(1, n // 5000)], full_matrices=False)[2][0]
        group = np.minimum((np.argsort(np.argsort(centred @ axis, kind="stable"), kind="stable") * k) // n, k - 1)
        moments[i, :, :n] = np.concatenate([np.ones((1, n)), centred.T, centred.T[up[0]] * centred.T[up[1]]])
        resp[i, group, np.arange(n)] = 1.0
    twice = np.where(up[0] == up[1], 0.5, 1.0)
    models: list[Mixture] = [None] * len(parts)
    which, last = np.arange(len(parts)), np.full(len(parts), -np.inf)
    for left in range(rounds, 0, -1):
        n = sizes[which]
        sums = resp @ moments.transpose(0, 2, 1)
        size = sums[:, :, 0] + 1e-12
        weights, means = size / n[:, None], sums[:, :, 1 : d + 1] / size[:, :, None]
        half = (sums[:, :, d + 1 :] - size[:, :, None] * means[:, :, up[0]] * means[:, :, up[1]]) / size[:, :, None]
        covs = np.empty((len(which), k, d, d))
        covs[:, :, up[0], up[1]] = covs[:, :, up[1], up[0]] = half
        covs = covs + reg * np.eye(d)
        if tied:
            covs = np.broadcast_to((weights[:, :, None, None] * covs).sum(1, keepdims=True), covs.shape)
        inverse = np.linalg.inv(covs)
        at = np.einsum("bkij,bkj->bki", inverse, means)
        constant = np.log(weights) - 0.5 * (np.linalg.slogdet(covs)[1] + d * math.log(2 * math.pi) + (at * means).sum(2))
        logp = np.concatenate([constant[:, :, None], at, -twice * inverse[:, :, up[0], up[1]]], 2) @ moments
        top = logp.max(1)
        resp = np.exp(logp - top[:, None], out=logp)
        total = resp.sum(1)
        resp /= total[:, None]
        level = ((top + np.log(total)) * moments[:, 0]).sum(1) / n
        done = (np.abs(level - last) < tol) | (left == 1)
        for i in np.flatnonzero(done):
            order = np.argsort(means[i, :, 0] + middle[which[i], 0], kind="stable")
            models[which[i]] = weights[i][order], (means[i] + middle[which[i]])[order], covs[i][order]
        if done.all():
            break
        last = level
        if done.any():
            which, last, resp, moments = which[~done], last[~done], resp[~done], moments[~done]
    return models


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(weights)))
    for j in range(len(weights)):
        root = np.linalg.cholesky(covs[j])
        z = np.linalg.solve(root, (x - means[j]).T)
        out[:, j] = np.log(weights[j]) - 0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def responsibilities(x: np.ndarray, model) -> np.ndarray:
    logp = log_densities(np.atleast_2d(x.astype(float).T).T, *model)
    p = np.exp(logp - logp.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def intersection(weights, means, variances) -> float:
    """Where two weighted normal densities cross: between the means if there is such a place."""
    (w0, w1), (m0, m1), (v0, v1) = ([max(float(a), floor) if floor else float(a) for a in p] for p, floor in ((weights, 1e-12), (means, 0), (variances, 1e-12)))
    middle = (m0 + m1) / 2
    roots = np.roots([1 / (2 * v0) - 1 / (2 * v1), m1 / v1 - m0 / v0, m0 * m0 / (2 * v0) - m1 * m1 / (2 * v1) - math.log(w0 / w1) + 0.5 * math.log(v0 / v1)])
    roots = roots[np.isreal(roots)].real
    inside = roots[(roots >= min(m0, m1)) & (roots <= max(m0, m1))]
    pick = inside if len(inside) else roots
    return float(pick[np.argmin(np.abs(pick - middle))]) if len(pick) else middle


def _weighted_quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
    order = np.argsort(x, kind="stable")
    running = np.cumsum(w[order])
    return float(x[order][min(np.searchsorted(running, q * running[-1]), len(x) - 1)])


def calibrate_marker(x: np.ndarray, start: float = 150.0, least: float = 100.0, most: float = 2000.0, rounds: int = 6, tol: float = 0.02, q: float = 0.99, min_events: int = 2000, fallback_q: float = 0.80, min_weight: float = 0.05, min_gap: float = 0.30, clip: float = 8.0) -> tuple[float, float]:
    """Cofactor and threshold of a marker from pooled values.

    The cofactor puts the upper end of the background at asinh(1): a two-component mixture's lower part or, where the
    background is faint or the components don't separate, the lower half of the values. The threshold is where the
    components of a last fit, at the final cofactor, cross. Few events: the first cofactor and a plain quantile. No
    finite value: NaN as threshold.
    """
    x = x[np.isfinite(x)]
    if len(x) < min_events:
        return start, float(np.quantile(np.arcsinh(x / start), fallback_q)) if len(x) else float("nan")

    def mixture(cofactor: float):
        t = np.clip(np.arcsinh(x / cofactor), -clip, clip)
        return t, fit_mixture(t, 2)

    c = start
    for _ in range(rounds):
        t, model = mixture(c)
        background = responsibilities(t, model)[:, 0]
        if background.mean() < min_weight or model[1][1, 0] - model[1][0, 0] < min_gap:
            edge = float(np.quantile(x[x <= np.median(x)], q))
        else:
            edge = c * math.sinh(_weighted_quantile(t, background, q))
        before, c = c, float(np.clip(edge / math.sinh(1.0), least, most))
        if abs(c - before) < tol * before:
            break
    weights, means, covs = mixture(c)[1]
    return c, intersection(weights, means[:, 0], covs[:, 0, 0])


def calibrate_markers(pool: DataFrame, marker: str, value: str, **options) -> DataFrame:
    """Cofactor and threshold per marker from a long pool of capped size (see ``sampling.pool_per_group``)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        c, t = calibrate_marker(df[value].to_numpy(float), **options)
        return pd.DataFrame({"marker": [df[marker].iloc[0]], "n": [len(df)], "cofactor": [c], "threshold": [t]})

    return pool.select(marker, value).groupBy(marker).applyInPandas(run, "marker string, n long, cofactor double, threshold double")


def label_clusters(events: DataFrame, cluster: str, markers: dict[str, float], fsc: str, ssc: str, least_share: float = 0.60, margin: float = 0.10, debris_q: float = 0.10) -> DataFrame:
    """Population of every cluster: debris by scatter, else the marker it is positive for, Unknown if two are as good.

    ``markers`` maps columns of transformed values to thresholds. Quantiles are exact selections; scores stay one row a
    cluster and marker.
    """
    used = staged(events.select(F.struct(F.col(cluster).alias("cluster")).alias("c"), *dict.fromkeys([fsc, ssc, *markers])), "to-label")
    # a cluster may hold a share of all events: no task keeps its values, nor all of a column's
    kinds = [F.struct(F.lit(n).alias("of"), F.col(c).cast("double").alias("v")) for n, c in (("fsc", fsc), ("ssc", ssc), *((f"med_{m}", m) for m in markers))]
    long = used.select("c", F.explode(F.array(*kinds)).alias("k")).select("c", "k.*")
    found = exact_quantiles(long, ["c", "of"], "v", [0.5])
    medians = found.groupBy("c").agg(*[F.max(F.when(F.col("of") == n, F.col("x"))).alias(n) for n in ("fsc", "ssc", *(f"med_{m}" for m in markers))])
    ends = exact_quantiles(long.where(F.col("of").isin("fsc", "ssc")), ["of"], "v", [debris_q])
    cut = ends.agg(*[F.max(F.when(F.col("of") == n, F.col("x"))).alias(a) for n, a in (("fsc", "__f"), ("ssc", "__s"))])
    counts = used.groupBy("c").agg(F.count("*").alias("n"), *[F.avg((F.col(m) > t).cast("int")).alias(f"share_{m}") for m, t in markers.items()])
    stats = counts.join(medians, "c", "left").withColumn("cluster", F.col("c.cluster")).drop("c").crossJoin(F.broadcast(cut))  # one row
    scores = [F.struct((F.col(f"med_{c}") - t).alias("score"), F.lit(c).alias("marker")) for c, t in markers.items()]
    able = F.filter(F.array(*[F.when((F.col(f"share_{c}") >= least_share) & (F.col(f"med_{c}") >= t), s) for (c, t), s in zip(markers.items(), scores, strict=True)]), lambda s: s.isNotNull())
    stats = staged(stats, "label-stats")  # a row per cluster
    unstaged(used, found, ends)
    stats = stats.withColumn("able", F.sort_array(able, asc=False))
    first, second = F.get("able", F.lit(0)), F.get("able", F.lit(1))
    label = (
        F.when((F.col("fsc") <= F.col("__f")) & (F.col("ssc") <= F.col("__s")), "Debris").when(F.size("able") == 0, "Unknown")
        .when((F.size("able") > 1) & (first["score"] - second["score"] < margin), "Unknown").otherwise(first["marker"])
    )
    return stats.select("cluster", "n", label.alias("population"))


def neighbour_vote(rows: DataFrame, training: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 15, max_training: int = 200_000, without_self: bool = False) -> DataFrame:
    """Label by majority of the k nearest training rows, with the vote's share and the outlier score 1 - share.

    The training set is a bounded sample and its size is checked; it goes to every task as a matrix, and rows are
    scored in blocks. Vectors that are null or of another dimension get nulls. Equal distances go to the smaller training id, equal votes to the smaller label. ``without_self``: a row's own id has no vote.
    """
    n = training.count()
    if n > max_training:
        raise ValueError(f"{n} training rows; sample them to {max_training} first")
    t = training.select(id_col, vec_col, label_col).where(F.col(vec_col).isNotNull()).orderBy(id_col).toPandas()
    sizes = t[vec_col].map(len)
    t = t[sizes == sizes.mode().max()] if len(t) else t  # of the most frequent dimension
    ids = t[id_col].to_numpy()
    x, y = np.stack(t[vec_col].to_list()).astype(np.float64) if len(t) else np.empty((0, 0)), t[label_col].to_numpy()
    kind, label_kind = rows.schema[id_col].dataType.simpleString(), training.schema[label_col].dataType.simpleString()

    def run(batches):
        square = (x * x).sum(1)
        for df in batches:
            other = np.array([v is None or len(v) != x.shape[1] for v in df[vec_col]], bool)
            if other.any():
                yield pd.DataFrame({id_col: df[id_col].to_numpy()[other], "predicted": None, "prob": None, "outlier": None})
            df = df[~other]
            for at in range(0, len(df), 256):
                part = df.iloc[at : at + 256]
                q = np.stack(part[vec_col].to_list()).astype(np.float64)
                d = square[None] - 2 * q @ x.T
                if without_self:
                    d[part[id_col].to_numpy()[:, None] == ids[None]] = np.inf
                near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
                labels, share = [], []
                for votes in y[near]:
                    names, counts = np.unique(votes, return_counts=True)
                    labels.append(names[counts.argmax()])
                    share.append(counts.max() / len(votes))
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "predicted": labels, "prob": share, "outlier": 1 - np.array(share)})

    return rows.select(id_col, vec_col).mapInPandas(run, f"{id_col} {kind}, predicted {label_kind}, prob double, outlier double")


def cluster_vectors(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means clusters of standardised features (column ``cluster``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(v).transform(v)
    fit = v.select("__scaled")
    # a task reads its part of the vectors in every round: parts are of bounded size, and not of the size of the files' splits
    most = max(fit.rdd.getNumPartitions(), fit.count() // ROWS_OF_A_PART + 1)
    model = KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="cluster", maxIter=20).fit(fit.repartition(most) if most > fit.rdd.getNumPartitions() else fit)
    return model.transform(v).drop("__raw", "__scaled")


def principal_components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """First k principal components of standardised features as an array column ``pc``."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(v).transform(v)
    v = PCA(k=k, inputCol="__scaled", outputCol="__pc").fit(v).transform(v)
    return v.withColumn("pc", vector_to_array("__pc")).drop("__raw", "__scaled", "__pc")


def accepted(predictions: DataFrame, types: DataFrame, cluster: str, least_prob: float = 0.2) -> DataFrame:
    """Adds the population of a prediction and whether it stands: no noise, likely enough, no outlier, no debris."""
    small = F.broadcast(types.select(F.col("cluster").alias("__c"), "population"))  # a row per cluster
    j = predictions.join(small, F.col(cluster) == F.col("__c"), "left").drop("__c").withColumn("population", F.coalesce("population", F.lit("Unknown")))
    bad = (F.col(cluster) < 0) | (F.col("prob") < least_prob) | (F.col("outlier") > F.col("threshold")) | (F.col("population") == "Debris")
    return j.withColumn("accepted", ~F.coalesce(bad, F.lit(True)))


def running_share(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("share", F.sum("n").over(w.orderBy(*order)) / F.sum("n").over(w))
