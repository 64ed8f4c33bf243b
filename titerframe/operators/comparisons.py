"""Tables that compare methods with raters: tiles joined to images, centres at many thresholds, error rates, loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, oks, precision_recall_f1
from .graphs import components
from .instances import object_counts, peaks
from .spatial import centroids, match_pairs

#: Thresholds of heat maps at which precision and recall are taken, and limits of keypoint similarity. Fixed values.
AP_THRESHOLDS = tuple(round(0.05 + 0.05 * i, 2) for i in range(14))
OKS_LIMITS = (0.5, 0.75, 0.9)


def tile_union(tiles: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "predicted", height: Column | int | None = None, width: Column | int | None = None) -> DataFrame:
    """Pixel agreement of an image over the union of its annotated tiles, every source pixel counted once.

    ``tiles`` has a row per annotated pixel of a tile: keys, y0, x0, ty, tx and two booleans. Where tiles overlap, truth is
    true if any tile says so and the prediction is that of the first tile by y0 and x0. Columns: keys, tp, tn, fp, fn,
    evaluated, overlap, truth_conflicts, predicted_conflicts, dice, jaccard and, with a size, coverage. Nulls are false.
    """
    at = [(F.col("y0") + F.col("ty")).alias("__y"), (F.col("x0") + F.col("tx")).alias("__x")]
    one = F.struct("y0", "x0", F.coalesce(F.col(truth), F.lit(False)).alias("t"), F.coalesce(F.col(predicted), F.lit(False)).alias("p"))
    px = tiles.groupBy(*keys, *at).agg(F.sort_array(F.collect_list(one)).alias("s"))  # the tiles that overlap at a pixel
    n, first = F.size("s"), F.get("s", F.lit(0))["p"]
    hits = F.size(F.filter("s", lambda v: v["t"]))
    seen = F.array_position(F.transform("s", lambda v: v["t"]), True)  # where truth is said first, 0 if nowhere
    px = px.select(
        *keys, (hits > 0).alias("t"), first.alias("p"), (n - 1).alias("overlap"), F.when(hits > 0, (seen > 1).cast("int") + n - hits - (seen - 1)).otherwise(0).alias("tc"),
        F.size(F.filter("s", lambda v: v["p"] != first)).alias("pc"),
    )
    t, p = F.col("t"), F.col("p")
    out = px.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("evaluated"),
        F.sum("overlap").alias("overlap"), F.sum("tc").alias("truth_conflicts"), F.sum("pc").alias("predicted_conflicts"),
    )
    out = out.withColumns(mask_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return out if height is None or width is None else out.withColumn("coverage", F.col("evaluated") / ((height if isinstance(height, Column) else F.lit(height)) * (width if isinstance(width, Column) else F.lit(width))))


def mask_rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Dice and Jaccard of counts; 1 where there is nothing to find and nothing found."""
    area, union = 2 * tp + fp + fn, tp + fp + fn
    return {"dice": F.when(area > 0, 2.0 * tp / F.when(area > 0, area)).otherwise(1.0), "jaccard": F.when(union > 0, tp / F.when(union > 0, union)).otherwise(1.0)}


def mask_totals(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Mask metrics of images whose tiles were scored one by one (tp, fp, fn, tn): rates of the summed counts."""
    out = tiles.groupBy(*keys).agg(F.count("*").alias("n_tiles"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    whole = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumns({"precision": p, "recall": r, "f1": f, "accuracy": (F.col("tp") + F.col("tn")) / F.when(whole > 0, whole)} | mask_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def mask_components(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Connected parts of the foreground (eight neighbours) per image: keys, n_components. Images without any have none."""
    px = labels.where("label > 0").select(*keys, "y", "x")
    node = F.struct(*keys, "y", "x")
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    near = px.select(*keys, node.alias("a"), "y", "x", step).select(*keys, "a", (F.col("y") + F.col("s.dy")).cast(px.schema["y"].dataType).alias("y"), (F.col("x") + F.col("s.dx")).cast(px.schema["x"].dataType).alias("x"))
    links = near.join(px, [*keys, "y", "x"]).select("a", node.alias("b"))
    parts = components(links, "a", "b").select("component").distinct()
    return parts.select(*[F.col(f"component.{k}").alias(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("n_components"))


def prediction_rows(truth: DataFrame, predicted: DataFrame, heat: DataFrame, keys: list[str], value: str, threshold: float, distance: int) -> DataFrame:
    """Counts of regions, connected parts and centres of every image against the true regions, with their errors and mask rates."""
    from .spatial import pixel_scores

    counts = object_counts(truth, predicted, keys).select(*keys, "n_truth", "n_predicted")
    found = peaks(heat, keys, value, threshold, distance).groupBy(*keys).agg(F.count("*").alias("n_centres"))
    out = counts.join(mask_components(predicted, keys), keys, "left").join(found, keys, "left").join(pixel_scores(truth, predicted, keys), keys, "left").fillna(0, ["n_components", "n_centres", "tp", "fp", "fn"])
    errors = {}
    for name, column in (("instances", "n_predicted"), ("components", "n_components"), ("centres", "n_centres")):
        error = F.col(column) - F.col("n_truth")
        errors |= {f"count_error_{name}": error, f"abs_count_error_{name}": F.abs(error)}
    return out.withColumns(errors | mask_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def centre_metrics(
    heat: DataFrame, truth: DataFrame, keys: list[str], value: str, threshold: float = 0.2, distance: int = 3, radius: float = 10.0, thresholds: tuple[float, ...] = AP_THRESHOLDS, k: float = 0.5, limits: tuple[float, ...] = OKS_LIMITS
) -> DataFrame:
    """Peaks of a heat map against the centres of true regions: a row per image.

    Peaks and centres match one to one within ``radius``, as many as can, then the nearest. Columns: keys, n_pred, n_gt, n_tp,
    precision, recall, f1, loc_mean (null without a match), ap (trapezoids of precision over recall at ``thresholds``, in
    order of recall, of equal ones the higher precision first), oks_0p5 and so on (share of matches whose keypoint
    similarity reaches the limit, scaled by the root of the median area) and oks_map, their mean.
    """
    every = tuple(dict.fromkeys((threshold, *thresholds)))
    regions = centroids(truth, keys)
    centres = regions.select(*keys, F.col("label").alias("g"), F.floor("cy").alias("gy"), F.floor("cx").alias("gx"))
    found = peaks(heat, keys, value, min(every), distance).select(*keys, "y", "x", "score")
    at = F.explode(F.filter(F.array(*[F.lit(float(v)) for v in every]), lambda v: v <= F.col("score"))).alias("thr")
    found = found.select(*keys, "y", "x", at)
    cell = lambda c: F.floor(F.col(c) / radius)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    around = centres.select("*", step).select(*keys, "g", "gy", "gx", (cell("gy") + F.col("s.a")).alias("__cy"), (cell("gx") + F.col("s.b")).alias("__cx"))
    pairs = found.withColumns({"__cy": cell("y"), "__cx": cell("x")}).join(around, [*keys, "__cy", "__cx"])
    pairs = pairs.withColumn("d", F.sqrt((F.col("y") - F.col("gy")) ** 2 + (F.col("x") - F.col("gx")) ** 2)).where(F.col("d") <= radius)
    pairs = pairs.withColumns({"peak": F.struct("y", "x"), "near": 1.0 - F.col("d") / (radius + 1.0)})
    matches = match_pairs(pairs.withColumn("peak", F.to_json("peak")), [*keys, "thr"], "peak", "g", "near", 0.0, most_pairs=True).withColumn("d", (1.0 - F.col("near")) * (radius + 1.0))

    images = heat.select(*keys).union(truth.select(*keys)).distinct()
    n_gt = centres.groupBy(*keys).agg(F.count("*").alias("n_gt"))
    grid = images.withColumn("thr", F.explode(F.array(*[F.lit(float(v)) for v in every])))
    sweep = grid.join(found.groupBy(*keys, "thr").agg(F.count("*").alias("n_pred")), [*keys, "thr"], "left").join(matches.groupBy(*keys, "thr").agg(F.count("*").alias("n_tp"), F.avg("d").alias("loc_mean")), [*keys, "thr"], "left")
    sweep = sweep.join(n_gt, keys, "left").fillna(0, ["n_pred", "n_tp", "n_gt"])
    tiny = 1e-8
    sweep = sweep.withColumns({"precision": F.col("n_tp") / (F.col("n_pred") + tiny), "recall": F.col("n_tp") / (F.col("n_gt") + tiny)})
    order = Window.partitionBy(*keys).orderBy("recall", F.desc("precision"), "thr")
    wide = (F.col("recall") - F.lag("recall").over(order)) * (F.col("precision") + F.lag("precision").over(order)) * 0.5
    ap = sweep.where(F.col("thr").isin(*map(float, thresholds))).withColumn("w", F.coalesce(wide, F.lit(0.0))).groupBy(*keys).agg(F.sum("w").alias("ap"))
    scale = regions.groupBy(*keys).agg(F.sqrt(F.percentile("area", 0.5)).alias("scale"))  # regions of one image
    similar = matches.where(F.col("thr") == float(threshold)).join(scale, keys).withColumn("oks", oks(F.col("d"), F.col("scale"), k))
    name = lambda v: f"oks_{v:g}".replace(".", "p")
    shares = similar.groupBy(*keys).agg(*[F.avg((F.col("oks") >= v).cast("int")).alias(name(v)) for v in limits])
    out = sweep.where(F.col("thr") == float(threshold)).withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + tiny))
    out = out.select(*keys, "n_pred", "n_gt", "n_tp", "precision", "recall", "f1", "loc_mean").join(ap, keys).join(shares, keys, "left")
    total = F.lit(0.0)
    for v in limits:
        total = total + F.col(name(v))
    return out.withColumn("oks_map", total / len(limits))


# ------------------------------------------------------------------------------------------------------------- loaders


def annotator_rows(scores: DataFrame, annotator: str, names: dict[str, str], required: list[str]) -> DataFrame:
    """A method's scores as rows of the raters' table: renamed columns, an annotator, missing required ones refused."""
    out = scores.withColumnsRenamed(names)
    if lacking := [c for c in required if c not in out.columns]:
        raise ValueError(f"columns missing: {lacking}")
    return out.withColumn("annotator", F.lit(annotator))


def evaluation_score(annotator: Column, score: Column, adjusted: Column, human: list[str]) -> Column:
    """Score that a rater is judged by: a person's own, a method's adjusted one, or its own where that is missing."""
    return F.when(annotator.cast("string").isin(*human), finite(score.cast("double"))).otherwise(F.coalesce(finite(adjusted.cast("double")), finite(score.cast("double"))))


def first_of_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of every combination of those of ``keys`` that the table has; all rows if it has none."""
    have = [k for k in keys if k in df.columns]
    if not have:
        return df
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*have).orderBy(*order))).where("__r = 1").drop("__r")


def count_error_percent(df: DataFrame, errors: list[str], totals: list[str]) -> DataFrame:
    """Adds count_error_pct of the first error and total columns that the table has, and their names; a total of 0 is none."""
    error, total = (next((c for c in names if c in df.columns), None) for names in (errors, totals))
    if error is None or total is None:
        return df.withColumn("count_error_pct", F.lit(None).cast("double"))
    n = F.col(total).try_cast("double")
    pct = F.col(error).try_cast("double") / F.when(n != 0, n) * 100.0
    return df.withColumns({"count_error_pct": pct, "count_error_pct_source": F.lit(error), "count_error_pct_denominator": F.lit(total)})


def checkpoints(paths: DataFrame, path: str, mode: str | None = None, modes: list[str] | None = None, include: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Model files of a mode and a range of epochs, both parsed from their names: adds mode and epoch (null if not said).

    With any limit on epochs, files without one go. Order by epoch and path.
    """
    if mode is not None and mode not in (modes or []):
        raise ValueError(f"unknown mode {mode}; there are {modes}")
    base = F.regexp_extract(path, r"([^/\\]+)$", 1)
    epoch = F.nullif(F.regexp_extract(base, r"(?i)epoch[_-]?(\d+)", 1), F.lit("")).cast("int")
    known = F.coalesce(*[F.when(base.contains(m), m) for m in sorted(modes, key=lambda m: (-len(m), m))], F.lit(None)) if modes else F.lit(None).cast("string")
    out = paths.withColumns({"mode": known, "epoch": epoch})
    if mode is not None:
        out = out.where(F.col("mode") == mode)
    if include is not None:
        out = out.where(F.col("epoch").isin(*include))
    if low is not None:
        out = out.where(F.col("epoch") >= low)
    return out if high is None else out.where(F.col("epoch") <= high)


#: Modes that a column of a crossmatch plate may have. Fixed values.
COLUMN_MODES = ("T", "B", "T/B", "empty")


def checked_modes(modes: DataFrame, column: str = "col", mode: str = "mode", columns: int = 10) -> DataFrame:
    """Modes of plate columns (one a column, the last wins); a column out of range or an unknown mode fails when read."""
    bad_column = F.raise_error(F.concat(F.lit(f"column must be between 1 and {columns}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")
    bad_mode = F.raise_error(F.concat(F.lit("unsupported mode of column "), F.col(column).cast("string"), F.lit(": "), F.coalesce(F.col(mode), F.lit("null")))).cast("boolean")
    fine = F.when(F.coalesce(F.col(column).between(1, columns), F.lit(False)), F.when(F.coalesce(F.col(mode).isin(*COLUMN_MODES), F.lit(False)), True).otherwise(bad_mode)).otherwise(bad_column)
    return modes.where(fine)
