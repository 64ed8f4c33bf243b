"""Queries of the clusterers and of the fitted gating chain, over the events of all files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, gating, sampling
from ..operators.staging import staged
from .proxies import PNR, events

KEY = ["l_orderkey", "l_linenumber"]
FEATURES = ["fsc_a", "ssc_a", "cd3", "cd19"]
#: Events that the clusterers which compare rows pair by pair are trained on.
TRAINING = 3000


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their key as a number, and their features: logarithms of scatter, transformed markers."""
    ev = events(spark, sf_dir).withColumn("event", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    scatter = [F.log1p(F.col(c)) for c in FEATURES[:2]]
    return ev.select("file_id", "event", *KEY, F.array(*scatter, *[F.asinh(F.col(c) / 150.0) for c in FEATURES[2:]]).alias("vec"))


def _drawn(rows: DataFrame, n: int = TRAINING) -> DataFrame:
    return staged(rows.orderBy(sampling.drawn(0, KEY), *KEY).limit(n), "training")


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id", "cluster").agg(F.count("*").alias("n"))


def som(spark, sf_dir):
    """Metaclusters of a map that all events are fitted on, counted by file."""
    rows = _features(spark, sf_dir)
    rows = staged(rows, "features")
    return _by_file(clustering.clusterer("som", width=6, height=6, n_clusters=8).fit(rows, "event", "vec").predict(rows, "vec"))


def density(spark, sf_dir):
    """Density clusters of drawn events, then of all by the nearest of those: counts, sure ones and outliers by file."""
    rows = _features(spark, sf_dir)
    fitted = clustering.clusterer("density", min_cluster_size=40).fit(_drawn(rows), "event", "vec")
    limit = float(fitted.labels["outlier"].quantile(0.99))
    out = fitted.predict(rows, "vec")
    return out.groupBy("file_id", "cluster").agg(F.count("*").alias("n"), F.count_if(F.col("prob") >= 0.2).alias("n_sure"), F.count_if(F.col("outlier") > limit).alias("n_outlier"))


def communities(spark, sf_dir):
    """Communities of drawn events' neighbour graph, then of all events by vote."""
    rows = _features(spark, sf_dir)
    out = clustering.clusterer("communities", knn=20).fit(_drawn(rows, 1000), "event", "vec").predict(rows, "vec")
    return out.groupBy("file_id", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("share"))


def _gater(**more) -> gating.EventGater:
    options = {"min_guide": 200, "subsample_per_file": 500, "tail_per_marker": 25}
    return gating.EventGater("file_id", "role", KEY, ["fsc_a", "fsc_h", "ssc_a"], "igg", ["cd3", "cd19"], PNR, options=options, **more)


def gater_readout(spark, sf_dir):
    """The whole chain fitted on all files and applied to them: population metrics by file and gate."""
    chain = _gater(clusterer="som", clustererOptions={"width": 6, "height": 6, "n_clusters": 10, "epochs": 6})
    model, gated = chain.fit_gated(events(spark, sf_dir))
    out = model.readouts_of(gated)
    return out.withColumns({c: F.round(c, 6) for c in ("pos_fraction", "median_raw", "median_t", "median_shift", "median_ratio", "fluorescence_index")})


QUERIES = {"ml_som": (som, None), "ml_density": (density, None), "ml_communities": (communities, None), "ml_gater_readout": (gater_readout, None)}
