"""Label maps against a reference: matched objects at several overlaps, aggregated Jaccard index, centres, boundaries.

Both sides are pixel tables (keys, y, x, label; 0 is background). Every score has a row per image that either side has,
empty images too; where there is nothing to find and nothing is found, scores are 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import precision_recall_f1
from .reports import IOU_THRESHOLDS
from .spatial import centroids, match_pairs, overlaps

#: Radii in pixels within which centres match. Fixed values.
CENTRE_RADII = (4.0, 6.0, 8.0)


def _offsets(keys: list[str], df: DataFrame, steps: list[tuple[int, int]], *more: str) -> DataFrame:
    """Every row moved by every step."""
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("__s")
    return df.select(*keys, "y", "x", *more, step).select(*keys, (F.col("y") + F.col("__s.dy")).alias("y"), (F.col("x") + F.col("__s.dx")).alias("x"), *more)


def object_counts(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Regions and labelled pixels of both sides per image: n_truth, n_predicted, truth_area, predicted_area."""
    sides = truth.select(*keys, F.lit(True).alias("t"), "label").union(predicted.select(*keys, F.lit(False), "label"))
    mine = lambda t: F.when((F.col("t") == t) & (F.col("label") > 0), F.col("label"))
    return sides.groupBy(*keys).agg(*[F.countDistinct(mine(t)).alias(f"n_{n}") for t, n in ((True, "truth"), (False, "predicted"))], *[F.count(mine(t)).alias(f"{n}_area") for t, n in ((True, "truth"), (False, "predicted"))])


def _rates(df: DataFrame) -> DataFrame:
    """Adds misses and rates to n_truth, n_predicted and tp."""
    df = df.withColumns({"fp": F.col("n_predicted") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp")})
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return df.withColumns({"precision": p, "recall": r, "f1": f})


def _at_each(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def _over(num: Column, den: Column) -> Column:
    return num / F.when(den > 0, den)


def object_scores(truth: DataFrame, predicted: DataFrame, keys: list[str], thresholds: tuple[float, ...] = IOU_THRESHOLDS) -> DataFrame:
    """Matched regions per image and IoU threshold, and how well they overlap.

    As many regions as can be are matched one to one at the threshold or above, then with the largest sum of IoU. Columns:
    keys, threshold, n_truth, n_predicted, tp, fp, fn, precision, recall, f1, mean_iou and mean_dice (of matches, null
    without any), mean_iou_all and mean_dice_all (misses count 0), pq.
    """
    pairs = _at_each(overlaps(truth, predicted, keys), "threshold", thresholds).where(F.col("iou") >= F.col("threshold"))
    matches = match_pairs(pairs, [*keys, "threshold"], "t", "p", "iou", 0.0, most_pairs=True)
    iou = F.col("iou")
    hits = matches.groupBy(*keys, "threshold").agg(F.count("*").alias("tp"), F.sum(iou).alias("sum_iou"), F.sum(2.0 * iou / (1.0 + iou)).alias("sum_dice"))
    grid = _at_each(object_counts(truth, predicted, keys).drop("truth_area", "predicted_area"), "threshold", thresholds)
    out = _rates(grid.join(hits, [*keys, "threshold"], "left").fillna(0, ["tp", "sum_iou", "sum_dice"]))
    n, tp = F.col("n_truth"), F.col("tp")
    alone = F.when(F.col("n_predicted") == 0, 1.0).otherwise(0.0)
    half = tp + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    return out.withColumns({
        "mean_iou": _over(F.col("sum_iou"), tp), "mean_dice": _over(F.col("sum_dice"), tp),
        "mean_iou_all": F.coalesce(_over(F.col("sum_iou"), n), alone), "mean_dice_all": F.coalesce(_over(F.col("sum_dice"), n), alone),
        "pq": F.coalesce(_over(F.col("sum_iou"), half), F.lit(1.0)),
    }).drop("sum_iou", "sum_dice")


def aggregated_jaccard(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Shared pixels of matched regions over the pixels of their unions and of all regions left over: keys, aji, matched_dice.

    All regions that share a pixel may match, as many as can be first. ``matched_dice`` is null without a match.
    """
    shared = overlaps(truth, predicted, keys)
    matches = match_pairs(shared, keys, "t", "p", "iou", 0.0, most_pairs=True).drop("iou").join(shared, [*keys, "t", "p"])
    # what is left over is everything but the matched areas, so the denominator is all areas less what is shared
    hits = matches.groupBy(*keys).agg(F.sum("inter").alias("inter"), F.avg("dice").alias("matched_dice"))
    out = object_counts(truth, predicted, keys).join(hits, keys, "left")
    inter = F.coalesce("inter", F.lit(0))
    whole = F.col("truth_area") + F.col("predicted_area") - inter
    aji = F.when((F.col("n_truth") > 0) & (F.col("n_predicted") > 0), inter / F.when(whole > 0, whole)).when(F.col("n_truth") + F.col("n_predicted") == 0, 1.0).otherwise(0.0)
    return out.select(*keys, aji.alias("aji"), "matched_dice")


def centre_pixels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """A pixel of every region at its centroid (keys, label, y, x): the rounded one, or if that is not the region's, its nearest.

    Halves round to even; of equally near pixels the first by y and x counts.
    """
    px = labels.where("label > 0").select(*keys, "y", "x", "label")
    at = px.join(centroids(px, keys).drop("area"), [*keys, "label"])
    far = ((F.col("y") != F.rint("cy")) | (F.col("x") != F.rint("cx"))).cast("int")
    d2 = (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2
    return at.groupBy(*keys, "label").agg(F.min(F.struct(far.alias("far"), d2.alias("d2"), "y", "x")).alias("p")).select(*keys, "label", "p.y", "p.x")


def centre_in_mask(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted regions that hold the centre pixel of a true one; a region counts once, so that merges gain nothing."""
    hit = centre_pixels(truth, keys).drop("label").join(predicted.where("label > 0").select(*keys, "y", "x", "label"), [*keys, "y", "x"])
    counts = object_counts(truth, predicted, keys).drop("truth_area", "predicted_area")
    return _rates(counts.join(hit.groupBy(*keys).agg(F.countDistinct("label").alias("tp")), keys, "left").fillna(0, ["tp"]))


def centre_scores(truth: DataFrame, predicted: DataFrame, keys: list[str], radii: tuple[float, ...] = CENTRE_RADII) -> DataFrame:
    """Centroids matched one to one within a radius, as many as can be, then the nearest: a row per image and radius.

    Centroids meet those of their own and the eight cells around, cells being as wide as the largest radius.
    """
    cell = max(radii)
    at = [F.floor(F.col(c) / cell).cast("long").alias(n) for c, n in (("cy", "y"), ("cx", "x"))]
    t = centroids(truth, keys).select(*keys, F.col("label").alias("t"), F.col("cy").alias("ty"), F.col("cx").alias("tx"), *at)
    p = centroids(predicted, keys).select(*keys, F.col("label").alias("p"), F.col("cy").alias("py"), F.col("cx").alias("px"), *at)
    near = t.join(_offsets(keys, p, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], "p", "py", "px"), [*keys, "y", "x"])
    near = near.withColumn("d", F.sqrt((F.col("ty") - F.col("py")) ** 2 + (F.col("tx") - F.col("px")) ** 2))
    pairs = _at_each(near, "radius", radii).where(F.col("d") <= F.col("radius")).withColumn("score", 1.0 - F.col("d") / (F.col("radius") + 1.0))
    matches = match_pairs(pairs, [*keys, "radius"], "t", "p", "score", 0.0, most_pairs=True)
    hits = matches.groupBy(*keys, "radius").agg(F.count("*").alias("tp"), F.avg((1.0 - F.col("score")) * (F.col("radius") + 1.0)).alias("mean_error"))
    grid = _at_each(object_counts(truth, predicted, keys).drop("truth_area", "predicted_area"), "radius", radii)
    return _rates(grid.join(hits, [*keys, "radius"], "left").fillna(0, ["tp"]))


def boundary(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Foreground pixels that have a neighbour of eight outside the foreground or the image: keys, y, x."""
    inside = labels.where("label > 0").select(*keys, "y", "x")
    around = _offsets(keys, inside, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]).groupBy(*keys, "y", "x").count().where("count = 8")
    return inside.join(around, [*keys, "y", "x"], "left_anti")


def boundary_scores(truth: DataFrame, predicted: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """Shares of boundary pixels within ``tolerance`` of the other side's boundary, and their F1.

    Every boundary pixel marks the disk around it; a side's pixels then look themselves up in the other side's disks. Two
    sides without a boundary score 1, one without 0.
    """
    disk = [(a, b) for a in range(-tolerance, tolerance + 1) for b in range(-tolerance, tolerance + 1) if a * a + b * b <= tolerance * tolerance]
    t, p = boundary(truth, keys), boundary(predicted, keys)

    def near(one: DataFrame, other: DataFrame, n: str) -> DataFrame:
        reached = _offsets(keys, other, disk).distinct().withColumn("near", F.lit(True))
        return one.join(reached, [*keys, "y", "x"], "left").groupBy(*keys).agg(F.count("*").alias(f"n_{n}"), F.count("near").alias(f"near_{n}"))

    images = truth.select(*keys).union(predicted.select(*keys)).distinct()
    out = images.join(near(p, t, "p"), keys, "left").join(near(t, p, "t"), keys, "left").fillna(0, ["n_p", "near_p", "n_t", "near_t"])
    nothing = F.when(F.col("n_p") + F.col("n_t") == 0, 1.0).otherwise(0.0)
    both = (F.col("n_p") > 0) & (F.col("n_t") > 0)
    out = out.withColumns({"precision": F.when(both, _over(F.col("near_p"), F.col("n_p"))).otherwise(nothing), "recall": F.when(both, _over(F.col("near_t"), F.col("n_t"))).otherwise(nothing)})
    total = F.col("precision") + F.col("recall")
    return out.select(*keys, "precision", "recall", F.coalesce(_over(2.0 * F.col("precision") * F.col("recall"), total), F.lit(0.0)).alias("f1"))


def comparison(truth: DataFrame, predicted: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """All scores of an image as one row: objects by threshold, aggregated Jaccard, centres by radius, boundaries."""
    objects = object_scores(truth, predicted, keys)
    centres = centre_scores(truth, predicted, keys)

    def wide(df: DataFrame, by: str, values: tuple[float, ...], prefix: str, columns: tuple[str, ...]) -> DataFrame:
        name = lambda v: f"{v:g}".replace(".", "p")
        return df.groupBy(*keys).agg(*[F.max(F.when(F.col(by) == v, F.col(c))).alias(f"{prefix}_{c}_{name(v)}") for v in values for c in columns])

    out = object_counts(truth, predicted, keys).join(wide(objects, "threshold", IOU_THRESHOLDS, "instance", ("tp", "fp", "fn", "precision", "recall", "f1", "mean_iou", "mean_dice", "pq")), keys)
    out = out.join(wide(centres, "radius", CENTRE_RADII, "center", ("tp", "fp", "fn", "precision", "recall", "f1", "mean_error")), keys)
    masks = centre_in_mask(truth, predicted, keys).select(*keys, *[F.col(c).alias(f"center_in_mask_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")])
    borders = boundary_scores(truth, predicted, keys, tolerance).select(*keys, *[F.col(c).alias(f"boundary_{c}") for c in ("precision", "recall", "f1")])
    for part in (aggregated_jaccard(truth, predicted, keys), masks, borders):
        out = out.join(part, keys)
    return out


def peaks(pixels: DataFrame, keys: list[str], value: str, threshold: float, distance: int) -> DataFrame:
    """Local maxima of a heat map: pixels of at least ``threshold`` that none within ``distance`` in y and x exceeds.

    The maximum filter is two aggregations, along x and along y. Pixels of equal height that touch are one plateau;
    plateau_y and plateau_x are its first pixel by y and x, so that rows where they are y and x are one peak each.
    Columns: keys, y, x, score, plateau_y, plateau_x. Missing pixels are below everything; null or NaN ones too.
    """
    from .graphs import components

    px = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    along = _offsets(keys, px, [(0, d) for d in range(-distance, distance + 1)], "v").groupBy(*keys, "y", "x").agg(F.max("v").alias("v"))
    highest = _offsets(keys, along, [(d, 0) for d in range(-distance, distance + 1)], "v").groupBy(*keys, "y", "x").agg(F.max("v").alias("top"))
    found = px.where(F.col("v") >= threshold)
    if distance > 1:  # a smaller one does not suppress anything
        found = found.join(highest, [*keys, "y", "x"]).where("v = top").drop("top")
    node = F.struct(*keys, "y", "x")
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    links = found.select("*", step).select(*keys, "v", node.alias("a"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = links.join(found.withColumnRenamed("v", "w"), [*keys, "y", "x"]).where("v = w").select("a", node.alias("b"))
    plateaus = components(links, "a", "b")
    out = found.withColumn("node", node).join(plateaus, "node", "left")
    first = lambda c: F.coalesce(F.col(f"component.{c}"), F.col(c)).alias(f"plateau_{c}")
    return out.select(*keys, "y", "x", F.col("v").alias("score"), first("y"), first("x"))
