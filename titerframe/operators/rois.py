"""ROI calibration and classification per plate, and well summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import cdc_score, corrected_fraction, finite, gaussian2_logpdf, red_green_ratio
from .statistics import exact_quantiles

SD_FLOOR, COV_EPS = 1e-6, 1e-6


def _is(role: str) -> Column:
    return F.col("role") == role


def _controls(rois: DataFrame, plate: list[str]) -> tuple[DataFrame, Column]:
    rg = red_green_ratio(F.col("mean_r"), F.col("mean_g"))
    return rois.where(F.col("role").isin("positive", "negative")).withColumn("rg", rg), F.col("rg")


def calibrate_midpoint(rois: DataFrame, plate: list[str], by: str = "median") -> DataFrame:
    """Threshold per plate halfway between the controls' median (or mean) red/green ratios."""
    use, rg = _controls(rois, plate)
    if by == "median":  # a plate may hold a share of all ROIs: no task keeps its values
        found = exact_quantiles(use.select(F.struct(*plate).alias("__p"), "role", "rg"), ["__p", "role"], "rg", [0.5])
        middle = found.groupBy("__p").agg(*[F.max(F.when(_is(r), F.col("x"))).alias(n) for r, n in (("positive", "pc"), ("negative", "nc"))])
        plates = use.select(F.struct(*plate).alias("__p")).distinct()
        out = plates.join(middle, "__p", "left").select(*[F.col("__p")[p].alias(p) for p in plate], "pc", "nc")
    else:
        out = use.groupBy(*plate).agg(A.mean(rg, _is("positive")).alias("pc"), A.mean(rg, _is("negative")).alias("nc"))
    return out.withColumn("threshold", (F.col("pc") + F.col("nc")) / 2.0)


def calibrate_gaussian(rois: DataFrame, plate: list[str]) -> DataFrame:
    """Mean and standard deviation (with a floor) of the controls' red/green ratios."""
    use, rg = _controls(rois, plate)

    def floor(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(SD_FLOOR))

    return use.groupBy(*plate).agg(
        A.mean(rg, _is("positive")).alias("mu_pc"), floor(A.sd(rg, _is("positive"))).alias("sd_pc"), A.mean(rg, _is("negative")).alias("mu_nc"), floor(A.sd(rg, _is("negative"))).alias("sd_nc"),
    )


def calibrate_gaussian2(rois: DataFrame, plate: list[str]) -> DataFrame:
    """Mean vectors and covariances of the controls' (red, green) means."""
    r, g = F.col("mean_r"), F.col("mean_g")
    out = []
    for name, role in (("pc", _is("positive")), ("nc", _is("negative"))):
        x, y = F.when(role, r), F.when(role, g)
        out += [F.avg(x).alias(f"r_{name}"), F.avg(y).alias(f"g_{name}"), (F.var_samp(x) + COV_EPS).alias(f"rr_{name}"), (F.var_samp(y) + COV_EPS).alias(f"gg_{name}"), F.covar_samp(x, y).alias(f"rg_{name}")]
    return rois.where(F.col("role").isin("positive", "negative")).groupBy(*plate).agg(*out)


def label_threshold(ratio: Column, threshold: Column) -> Column:
    return F.when(finite(ratio).isNull() | threshold.isNull(), "uncertain").when(ratio >= threshold, "pos").otherwise("neg")


def label_above_negative(ratio: Column, mu: Column, sd: Column, k: float = 3.0) -> Column:
    return F.when((ratio - mu) / sd >= k, "pos").otherwise("uncertain")


def label_below_positive(ratio: Column, mu: Column, sd: Column, k: float = 3.0) -> Column:
    return F.when((ratio - mu) / sd <= -k, "neg").otherwise("uncertain")


def label_gaussian(ratio: Column, mu_nc: Column, sd_nc: Column, mu_pc: Column, sd_pc: Column, k: float = 2.0) -> Column:
    """Positive if clearly above the negative control, else negative if clearly below the positive one."""
    return F.when((ratio - mu_nc) / sd_nc >= k, "pos").when((ratio - mu_pc) / sd_pc <= -k, "neg").otherwise("uncertain")


def score_gaussian2(rois: DataFrame, calibration: DataFrame, plate: list[str], margin: float = 1.0) -> DataFrame:
    """Adds score (difference of log densities) and label to every ROI. ``calibration`` has a row per plate."""
    joined = rois.join(calibration, plate, "left")
    logp = [gaussian2_logpdf(F.col("mean_r"), F.col("mean_g"), *[F.col(f"{c}_{n}") for c in ("r", "g", "rr", "gg", "rg")]) for n in ("pc", "nc")]
    score = finite(logp[0] - logp[1])
    label = F.when(score > margin, "pos").when(score < -margin, "neg").otherwise("uncertain")
    return joined.withColumn("score", score).withColumn("label", label).select(*rois.columns, "score", "label")


def well_summary(rois: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and fractions per well: of decided ROIs (raw) and of all ROIs."""
    pos, neg = F.col("label") == "pos", F.col("label") == "neg"
    out = rois.groupBy(*keys).agg(F.count("*").alias("n_rois"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.count_if(F.col("label") == "uncertain").alias("n_uncertain"))
    decided = F.col("n_pos") + F.col("n_neg")
    return out.withColumns({
        "frac_pos_raw": 100.0 * F.col("n_pos") / F.when(decided > 0, decided),
        "frac_pos": F.when(F.col("n_rois") > 0, 100.0 * F.col("n_pos") / F.when(F.col("n_rois") > 0, F.col("n_rois"))).otherwise(0.0),
        "frac_uncertain": F.col("n_uncertain") / F.when(F.col("n_rois") > 0, F.col("n_rois")),
    })


def corrected_wells(wells: DataFrame, plate: list[str]) -> DataFrame:
    """Adds the plate's control references, the corrected percentage and the ordinal scores."""
    refs = wells.groupBy(*plate).agg(A.mean(F.col("frac_pos_raw"), _is("positive")).alias("pc_ref"), A.mean(F.col("frac_pos_raw"), _is("negative")).alias("nc_ref"))
    joined = wells.join(refs, plate)
    corrected = corrected_fraction(F.col("frac_pos_raw"), F.col("nc_ref"), F.col("pc_ref"))
    return joined.withColumn("corrected", corrected).withColumns({"score": cdc_score(F.col("frac_pos_raw")), "adjusted_score": cdc_score(F.col("corrected"))})


def qc_reasons(df: DataFrame, area_z: Column, touching: Column, border: Column, limit: float = 3.5) -> DataFrame:
    """Adds the list of reasons for which a ROI is excluded, and whether it is."""
    reasons = F.array_compact(F.array(F.when(touching, "touching"), F.when(border, "border"), F.when(F.abs(area_z) > limit, "area")))
    return df.withColumn("reasons", reasons).withColumn("excluded", F.size("reasons") > 0)


def shape_reasons(df: DataFrame, min_area: int = 0, z_isolated: float = 3.5, z_touching: float = 4.5, min_circularity: float = 0.4, min_solidity: float = 0.80, max_eccentricity: float = 0.95, min_gap: float = 0.15) -> DataFrame:
    """Adds all reasons for which a ROI is excluded, and whether it is.

    Needs violating, border, degree, area, area_z, circularity, solidity, eccentricity and gap (null: not measured).
    """
    alone = F.col("degree") == 0
    z = F.abs("area_z")
    rules = [
        F.when(F.col("violating"), "touching_violation"), F.when(F.col("area") < min_area, "too_small"), F.when(F.col("border"), "border_touch"),
        F.when(alone & (z > z_isolated), "area_outlier").when(~alone & (z > z_touching), "area_outlier_touching"),
        F.when((F.col("circularity") < min_circularity) & ~alone & (F.col("solidity") < min_solidity), "merge_shape"),
        F.when((F.col("eccentricity") > max_eccentricity) & alone, "too_elongated"), F.when(F.col("gap") < min_gap, "weak_boundary"),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("excluded", F.size("reasons") > 0)


#: Calibrators by name: (ROIs, plate columns) -> a row per plate. :func:`register_calibrator` adds more.
CALIBRATORS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "median": calibrate_midpoint, "mean": lambda rois, plate: calibrate_midpoint(rois, plate, "mean"), "gaussian": calibrate_gaussian, "gaussian2": calibrate_gaussian2,
}


def _ratio() -> Column:
    return red_green_ratio(F.col("mean_r"), F.col("mean_g"))


def _gaussian2(margin: float = 1.0) -> Column:
    logp = [gaussian2_logpdf(F.col("mean_r"), F.col("mean_g"), *[F.col(f"{c}_{n}") for c in ("r", "g", "rr", "gg", "rg")]) for n in ("pc", "nc")]
    score = finite(logp[0] - logp[1])
    return F.when(score > margin, "pos").when(score < -margin, "neg").otherwise("uncertain")


#: Classifiers by name: their usual calibrator, and a function of options that gives the label of a ROI joined with its
#: plate's calibration. :func:`register_classifier` adds more.
CLASSIFIERS: dict[str, tuple[str, Callable[..., Column]]] = {
    "midpoint": ("median", lambda: label_threshold(_ratio(), F.col("threshold"))),
    "nc_upper": ("gaussian", lambda k=3.0: label_above_negative(_ratio(), F.col("mu_nc"), F.col("sd_nc"), k)),
    "pc_lower": ("gaussian", lambda k=3.0: label_below_positive(_ratio(), F.col("mu_pc"), F.col("sd_pc"), k)),
    "gaussian": ("gaussian", lambda k=2.0: label_gaussian(_ratio(), F.col("mu_nc"), F.col("sd_nc"), F.col("mu_pc"), F.col("sd_pc"), k)),
    "gaussian2": ("gaussian2", _gaussian2),
}


def register_calibrator(name: str, calibrator: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    CALIBRATORS[name] = calibrator


def register_classifier(name: str, calibrator: str, label: Callable[..., Column]) -> None:
    """``label`` sees mean_r, mean_g and the calibrator's columns, and gives pos, neg or uncertain."""
    CLASSIFIERS[name] = (calibrator, label)


def classified(rois: DataFrame, plate: list[str], classifier: str, calibrator: str | None = None, **options) -> DataFrame:
    """ROIs with the label of a registered classifier, calibrated on their plate's controls."""
    if classifier not in CLASSIFIERS or (calibrator or "median") not in CALIBRATORS:
        raise KeyError(f"no {classifier} or {calibrator}; there are {sorted(CLASSIFIERS)} and {sorted(CALIBRATORS)}")
    usual, label = CLASSIFIERS[classifier]
    calibration = CALIBRATORS[calibrator or usual](rois, plate)
    return rois.join(calibration, plate, "left").withColumn("label", label(**options)).select(*rois.columns, "label")


def score_rois(rois: DataFrame, plate: list[str], wells: int | None = None, classifier: str = "gaussian2", calibrator: str | None = None, **options) -> DataFrame:
    """ROI tables to scored wells: calibrate, classify, summarise, correct, score, by registered names.

    Plates without either control, or with another number of wells than ``wells``, are left out. ``options`` go to the
    classifier; ``calibrator`` replaces its usual one. Adds calib_method and classifier_method.
    """
    whole = rois.groupBy(*plate).agg(F.countDistinct("well").alias("__n"), F.count_if(_is("positive")).alias("__p"), F.count_if(_is("negative")).alias("__q")).where("__p > 0 AND __q > 0")
    whole = whole if wells is None else whole.where(F.col("__n") == wells)
    rois = rois.join(whole.select(*plate), plate, "left_semi")
    labelled = classified(rois, plate, classifier, calibrator, **options)
    out = corrected_wells(well_summary(labelled, [*plate, "well", "role"]), plate)
    return out.withColumns({"calib_method": F.lit(calibrator or CLASSIFIERS[classifier][0]), "classifier_method": F.lit(classifier)})


#: Percentages that a human score stands for when it is turned back into one. Fixed values.
SCORE_RANGES = {1: (0.0, 10.0), 2: (10.0, 20.0), 4: (20.0, 40.0), 6: (40.0, 60.0), 8: (80.0, 100.0), 0: (0.0, 2.0), 11: (0.0, 10.0)}


def backfilled_scores(
    scores: DataFrame, row: list[str], human: list[str], methods: list[str], folder: str = "folder", annotator: str = "annotator", score: str = "score", fraction: str = "frac_pos", ranges: dict[int, tuple[float, float]] | None = None, keep: bool = False, source: str = "corrected", seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Scores of people and methods on one scale: (rows, references).

    A human score becomes a percentage in its range, spread by the md5 of seed and row key, so that reruns agree (with
    ``keep`` only where there is none); methods keep theirs. References are mean percentages of the controls per folder and
    annotator; rows get them as pc_ref and nc_ref, with corrected and adjusted_score (of ``source``: corrected, or the
    fraction itself). Rows of other annotators stay as they are, with nulls. A human score without a range fails when read.
    """
    if source not in ("corrected", fraction):
        raise ValueError(f"source is corrected or {fraction}")
    spans = SCORE_RANGES if ranges is None else ranges
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row])), 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = F.raise_error(F.concat(F.lit("no range for the score "), F.coalesce(F.col(score).cast("string"), F.lit("null")))).cast("double")
    for value, (low, high) in spans.items():
        drawn = F.when(F.col(score) == value, low + u * (high - low)).otherwise(drawn)
    who = F.col(annotator).cast("string")
    given = finite(F.col(fraction).cast("double"))
    rows = scores.withColumn(fraction, F.when(who.isin(*human), F.coalesce(given, drawn) if keep else drawn).otherwise(given))
    rated = who.isin(*human, *methods)
    refs = rows.where(rated).groupBy(folder, annotator).agg(A.mean(F.col(fraction), _is("positive")).alias("pc_ref"), A.mean(F.col(fraction), _is("negative")).alias("nc_ref"))
    out = rows.drop("pc_ref", "nc_ref", "corrected", "adjusted_score").join(refs, [folder, annotator], "left")
    out = out.withColumn("corrected", F.when(rated, corrected_fraction(F.col(fraction), F.col("nc_ref"), F.col("pc_ref"))))
    return out.withColumn("adjusted_score", F.when(rated, cdc_score(F.col(source)))), refs
