"""The gating chain as one object: an Estimator that fits quality control to control cutoffs, and its Model.

Fitting runs eight stages on the events of all files at once: edge and singlet gates, marker calibration, lymphocytes
around the marker guide, a training pool, robust scaling, clustering, labelling of clusters, and control statistics per
gate. The model keeps what they decided as small tables, is saved and loaded like any other of ``pyspark.ml``, and gates
all files in one set-oriented pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import asinh_t, finite, log1p_clipped, skip_outliers
from . import gates, mixture_gates, models, readouts, sampling
from .clustering import Fitted, clusterer
from .reports import training_pool
from .staging import staged, unstaged
from .statistics import exact_quantiles

ALL, SINGLETS, LYMPHOCYTES = "All Cells", "Singlets", "Lymphocytes"
#: Options of the chain and their defaults. Fixed values.
DEFAULTS = {
    "cofactor": 150.0, "hi_frac": 0.95, "marker_per_file": 5000, "marker_total": 120_000, "subsample_per_file": 5000, "tail_q": 0.99, "tail_per_marker": 250, "min_training": 2000,
    "z_eps": 1e-6, "z_clip": 8.0, "least_prob": 0.2, "outlier_q": 0.99, "least_share": 0.60, "margin": 0.10, "debris_q": 0.10, "min_guide": 500, "min_nc": 2000, "min_pc": 2000,
}


class _GatingParams(Params):
    fileCol = Param(Params._dummy(), "fileCol", "column that tells files apart", TypeConverters.toString)
    roleCol = Param(Params._dummy(), "roleCol", "column with NC, PC or another role of the file", TypeConverters.toString)
    rowCols = Param(Params._dummy(), "rowCols", "columns that tell the events of a file apart", TypeConverters.toListString)
    scatter = Param(Params._dummy(), "scatter", "channels: forward scatter area and height, side scatter area", TypeConverters.toListString)
    reporter = Param(Params._dummy(), "reporter", "channel that is read out", TypeConverters.toString)
    markers = Param(Params._dummy(), "markers", "channels of the lineage markers", TypeConverters.toListString)
    limit = Param(Params._dummy(), "limit", "largest value of a channel", TypeConverters.toFloat)
    clusterer = Param(Params._dummy(), "clusterer", "name of a registered clusterer", TypeConverters.toString)
    clustererOptions = Param(Params._dummy(), "clustererOptions", "its options as JSON", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options of the chain as JSON, over the defaults", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the hashes that draw samples", TypeConverters.toInt)

    def _option(self, name: str) -> Any:
        return {**DEFAULTS, **json.loads(self.getOrDefault(self.options))}[name]

    def _quality(self, events: DataFrame) -> DataFrame:
        """Adds the masks ``edge``, ``singlet`` and ``qc``."""
        area, height, side = self.getOrDefault(self.scatter)
        edge = gates.edge_gate([area, side, height], self.getOrDefault(self.limit), hi_frac=self._option("hi_frac"))
        rows = gates.singlets_mad(events.withColumn("edge", edge), self.getOrDefault(self.fileCol), area, height)
        return rows.withColumn("qc", F.col("edge") & F.col("singlet"))

    def _lymphocytes(self, rows: DataFrame, markers: pd.DataFrame) -> DataFrame:
        """Adds the mask ``lymph``: lymphocytes among the events that passed, around those positive for any marker."""
        area, _, side = self.getOrDefault(self.scatter)
        guide = F.lit(False)
        for m in markers.itertuples():
            if m.threshold == m.threshold:  # without any value there is no threshold
                guide = guide | gates.marker_positive(F.col(m.marker), float(m.cofactor), float(m.threshold))
        cfg = mixture_gates.GuideConfig(min_guide=self._option("min_guide"), min_low_fit=self._option("min_guide"))
        return mixture_gates.lymphocytes_guided(rows, self.getOrDefault(self.fileCol), self.getOrDefault(self.rowCols), F.col("qc"), guide, area, side, "lymph", cfg, self.getOrDefault(self.seed))

    def _features(self, markers: pd.DataFrame) -> dict[str, Column]:
        """Features of an event before scaling: logarithms of scatter and transformed markers."""
        area, _, side = self.getOrDefault(self.scatter)
        scatter = {area: log1p_clipped(F.col(area)), side: log1p_clipped(F.col(side))}
        return scatter | {m.marker: asinh_t(F.col(m.marker), float(m.cofactor)) for m in markers.itertuples()}


def _scaled(features: dict[str, Column], scaler: pd.DataFrame, eps: float, clip: float) -> Column:
    """The features as one array, each less its median over its deviation, clipped."""
    at = scaler.set_index("feature")
    return F.array(*[skip_outliers((c - float(at.loc[f, "med"])) / max(float(at.loc[f, "mad"]), eps), clip) for f, c in features.items()])


class EventGater(Estimator, _GatingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the chain on the events of all files; the table has a row per event and a column per channel.

    Progress is told by a callback of the stage's name (``tell``), as fitting goes on. Fewer than ``min_training`` (2000)
    lymphocytes to train on raise. Nulls and not finite values fail the gates; a file without events has no row anywhere.
    """

    STAGES = ("fit_qc", "fit_marker_calibration", "fit_lymphocytes", "fit_training_pool", "fit_scaling", "fit_clustering", "fit_cluster_labels", "fit_control_stats")

    def __init__(
        self, fileCol: str = "file_id", roleCol: str = "role", rowCols: list[str] | None = None, scatter: list[str] | None = None, reporter: str = "igg", markers: list[str] | None = None, limit: float = 262144.0,
        clusterer: str = "communities", clustererOptions: dict | None = None, options: dict | None = None, seed: int = 187, tell: Callable[[str], None] | None = None,
    ):
        super().__init__()
        unknown = set(options or {}) - set(DEFAULTS)
        if unknown:
            raise KeyError(f"no options {sorted(unknown)}; there are {sorted(DEFAULTS)}")
        self._set(
            fileCol=fileCol, roleCol=roleCol, rowCols=rowCols or ["event"], scatter=scatter or ["fsc_a", "fsc_h", "ssc_a"], reporter=reporter, markers=markers or [], limit=limit,
            clusterer=clusterer, clustererOptions=json.dumps(clustererOptions or {}), options=json.dumps(options or {}), seed=seed,
        )
        self.tell = tell

    def _say(self, stage: str) -> None:
        if getattr(self, "tell", None):
            self.tell(stage)

    def _fit(self, dataset: DataFrame) -> EventGaterModel:
        model, gated = self.fit_gated(dataset)
        unstaged(gated)
        return model

    def fit_gated(self, dataset: DataFrame) -> tuple[EventGaterModel, DataFrame]:
        """The model, and its rows of the events that it is fitted on: what ``transform`` would compute again for them.

        The rows have the columns that the chain uses, and lie in the scratch folder.
        """
        file, row, seed = self.getOrDefault(self.fileCol), self.getOrDefault(self.rowCols), self.getOrDefault(self.seed)
        role, reporter, names = self.getOrDefault(self.roleCol), self.getOrDefault(self.reporter), self.getOrDefault(self.markers)
        area, height, side = self.getOrDefault(self.scatter)
        used = list(dict.fromkeys([file, role, *row, area, height, side, reporter, *names]))

        self._say("fit_qc")
        passed = staged(self._quality(dataset.select(*used)), "gater-qc")

        self._say("fit_marker_calibration")
        long = passed.where("qc").select(file, *row, *names).unpivot([file, *row], names, "marker", "value")
        pool = sampling.pool_per_group(long, ["marker"], [file], row, self._option("marker_per_file"), self._option("marker_total"), seed)
        found = models.calibrate_markers(pool, "marker", "value").toPandas().set_index("marker")  # a row per marker
        markers = pd.DataFrame({"marker": names, "cofactor": [float(found["cofactor"].get(m, self._option("cofactor"))) for m in names], "threshold": [float(found["threshold"].get(m, float("nan"))) for m in names]})

        self._say("fit_lymphocytes")
        rows = staged(self._lymphocytes(passed, markers), "gater-lymph")
        unstaged(passed)

        self._say("fit_training_pool")
        features = self._features(markers)
        drawn = training_pool(rows, file, row, F.col("lymph"), names, self._option("subsample_per_file"), self._option("tail_q"), self._option("tail_per_marker"))
        key = F.xxhash64(F.lit(seed), file, *row)
        drawn = staged(drawn.select(key.alias("id"), *[c.alias(f) for f, c in features.items()]), "gater-pool")
        n = drawn.count()
        if n < self._option("min_training"):
            unstaged(drawn, rows)
            raise ValueError(f"{n} lymphocytes are too few to cluster; {self._option('min_training')} are needed")

        self._say("fit_scaling")
        scaler = median_deviations(drawn, list(features))
        plain = {f: F.col(f) for f in features}
        train = staged(drawn.withColumn("vec", _scaled(plain, scaler, self._option("z_eps"), self._option("z_clip"))), "gater-train")
        unstaged(drawn)

        self._say("fit_clustering")
        fitted = clusterer(self.getOrDefault(self.clusterer), **json.loads(self.getOrDefault(self.clustererOptions))).fit(train, "id", "vec")
        limit = float(fitted.labels["outlier"].quantile(self._option("outlier_q"))) if "outlier" in fitted.labels and len(fitted.labels) else float("inf")

        self._say("fit_cluster_labels")
        known = self._training_labels(train, fitted)
        types = models.label_clusters(
            known.where("cluster >= 0"), "cluster", dict(zip(markers["marker"], markers["threshold"], strict=True)), area, side, self._option("least_share"), self._option("margin"), self._option("debris_q")
        ).toPandas()  # a row per cluster
        unstaged(train)

        self._say("fit_control_stats")
        model = EventGaterModel(markers, scaler, fitted, types, limit, None)
        self._copyValues(model)
        gated = staged(model.gated(rows), "gater-gated")
        controls = readouts.control_stats(gates.explode_gates(gated, model.gates()), "gate", role, reporter, "t", min_nc=self._option("min_nc"), min_pc=self._option("min_pc"))
        model.controls = controls.toPandas()  # a row per gate
        unstaged(rows, controls)
        return model, gated

    def _training_labels(self, train: DataFrame, fitted: Fitted) -> DataFrame:
        """The training rows with their clusters: those of the fit, or predicted where a clusterer keeps none."""
        if not len(fitted.labels):
            return fitted.predict(train, "vec")
        labels = train.sparkSession.createDataFrame(fitted.labels[["id", "cluster"]])
        return train.join(labels, "id")


def median_deviations(rows: DataFrame, features: list[str]) -> pd.DataFrame:
    """Median and median absolute deviation of every feature over all rows: feature, med, mad. Exact at any size."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("e")).select("e.*")
    med = exact_quantiles(long, ["feature"], "v", [0.5])
    off = long.join(F.broadcast(med.select("feature", F.col("x").alias("med"))), "feature").select("feature", F.abs(F.col("v") - F.col("med")).alias("v"))  # a row per feature
    mad = exact_quantiles(off, ["feature"], "v", [0.5])
    out = med.select("feature", F.col("x").alias("med")).join(mad.select("feature", F.col("x").alias("mad")), "feature").toPandas()
    unstaged(med, mad)
    return out.set_index("feature").reindex(features).reset_index().fillna({"med": 0.0, "mad": 0.0})


class EventGaterModel(Model, _GatingParams, MLWritable, MLReadable):
    """A fitted chain: markers, scaler, clusterer, populations of its clusters, outlier limit and controls by gate."""

    def __init__(self, markers: pd.DataFrame | None = None, scaler: pd.DataFrame | None = None, fitted: Fitted | None = None, types: pd.DataFrame | None = None, outlier_limit: float = float("inf"), controls: pd.DataFrame | None = None):
        super().__init__()
        self.marker_table, self.scaler, self.fitted, self.types, self.outlier_limit, self.controls = markers, scaler, fitted, types, outlier_limit, controls

    def gates(self) -> dict[str, Column]:
        """The gates of the chain as masks over :meth:`transform`'s columns; populations by marker."""
        out = {ALL: F.col("edge"), SINGLETS: F.col("qc"), LYMPHOCYTES: F.col("accepted")}
        return out | {m: F.col("accepted") & (F.col("population") == m) for m in self.marker_table["marker"]}

    def gated(self, rows: DataFrame) -> DataFrame:
        """Adds cluster, prob, outlier, population, accepted and the transformed reporter ``t`` to rows with their masks."""
        vec = _scaled(self._features(self.marker_table), self.scaler, self._option("z_eps"), self._option("z_clip"))
        rows = self.fitted.predict(rows.withColumn("__vec", F.when(F.col("lymph"), vec)), "__vec").drop("__vec")
        pairs = [F.lit(v) for r in self.types.itertuples() for v in (int(r.cluster), r.population)]
        population = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("cluster")) if pairs else F.lit(None), F.lit("Unknown"))
        out = (F.col("cluster") < 0) | (F.coalesce("prob", F.lit(1.0)) < self._option("least_prob")) | (F.coalesce("outlier", F.lit(0.0)) > self.outlier_limit)
        rows = rows.withColumn("population", F.when(F.col("cluster").isNotNull(), population))
        accepted = F.col("lymph") & F.coalesce(~out & (F.col("population") != "Debris"), F.lit(False))
        return rows.withColumns({"accepted": accepted, "t": asinh_t(F.col(self.getOrDefault(self.reporter)), self._option("cofactor"))})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All events of all files with edge, singlet, qc, lymph, cluster, prob, outlier, population, accepted and t."""
        return self.gated(self._lymphocytes(self._quality(dataset), self.marker_table))

    def readouts(self, events: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Population metrics per file, or per ``keys`` over all of their files, and gate, against the fitted controls."""
        return self.readouts_of(self.transform(events), keys)

    def readouts_of(self, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """:meth:`readouts` of rows that are gated already, by ``transform`` or by ``fit_gated``."""
        keys = keys or [self.getOrDefault(self.fileCol)]
        controls = rows.sparkSession.createDataFrame(self.controls)
        controls = controls.withColumns({c: finite(F.col(c)) for c, kind in controls.dtypes if kind == "double"})  # missing again, not NaN
        rows = rows.select(*keys, self.getOrDefault(self.reporter), "t", "edge", "qc", "accepted", "population")
        return readouts.readouts_of_gates(rows, keys, self.gates(), self.getOrDefault(self.reporter), "t", controls)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


_TABLES = ("marker_table", "scaler", "types", "controls")


class _ModelWriter(MLWriter):
    def __init__(self, model: EventGaterModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark.sparkContext, {"outlier_limit": repr(self.model.outlier_limit)})
        for name in _TABLES:
            df = getattr(self.model, name)
            spark.createDataFrame(df.assign(__at=range(len(df)))).write.parquet(f"{path}/{name}")
        self.model.fitted.save(spark, f"{path}/clusterer")


class _ModelReader(MLReader):
    def load(self, path: str) -> EventGaterModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext, f"{EventGaterModel.__module__}.EventGaterModel")
        model = EventGaterModel(outlier_limit=float(metadata["outlier_limit"]))
        for name in _TABLES:
            setattr(model, name, spark.read.parquet(f"{path}/{name}").orderBy("__at").drop("__at").toPandas())
        model.fitted = Fitted.load(spark, f"{path}/clusterer")
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
