"""Label maps as pixel tables (image, y, x, label, channels; label 0 is background), centroids and matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .staging import staged


def region_means(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Area and channel means per labelled region."""
    return pixels.where("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("area"), *[F.avg(c).alias(f"mean_{c}") for c in channels])


def centroids(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.where("label > 0").groupBy(*keys, "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("area"))


def border_labels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with a pixel on the image's edge."""
    size = pixels.groupBy(*keys).agg(F.max("y").alias("__y"), F.max("x").alias("__x"), F.min("y").alias("__y0"), F.min("x").alias("__x0"))
    on = (F.col("y") == F.col("__y")) | (F.col("x") == F.col("__x")) | (F.col("y") == F.col("__y0")) | (F.col("x") == F.col("__x0"))
    return pixels.where("label > 0").join(size, keys).where(on).select(*keys, "label").distinct()


def adjacent_labels(pixels: DataFrame, keys: list[str], height: int | None = None, width: int | None = None) -> DataFrame:
    """Pairs of labels that touch (8 neighbours). With a size, edges wrap around.

    Each pixel looks at four of its neighbours: the pairs come out once, by an equi-join on the place.
    """
    p = pixels.where("label > 0").select(*keys, "y", "x", "label")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    y, x = F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")
    if height and width:
        y, x = F.pmod(y, F.lit(height)), F.pmod(x, F.lit(width))
    near = p.select("*", steps).select(*keys, y.cast(p.schema["y"].dataType).alias("y"), x.cast(p.schema["x"].dataType).alias("x"), F.col("label").alias("other"))
    met = near.join(p, [*keys, "y", "x"]).where("label <> other")
    return met.select(*keys, F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def focus(pixels: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Variance of the 4-neighbour Laplacian over inner pixels, mean, deviation and saturated share per image."""
    p = pixels.select(*keys, "y", "x", F.col(channel).alias("v"))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("s")
    near = p.select("*", shift).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("v").alias("w"))
    around = near.groupBy(*keys, "y", "x").agg(F.sum("w").alias("around"), F.count("*").alias("k"))
    j = p.join(around, [*keys, "y", "x"], "left")
    return j.groupBy(*keys).agg(F.var_pop(F.when(F.col("k") == 4, F.col("around") - 4 * F.col("v"))).alias("laplacian_var"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.avg((F.col("v") >= 1.0).cast("int")).alias("saturated"))


def overlaps(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Intersections, areas, IoU and Dice of the region pairs that share pixels."""
    t = truth.where("label > 0").select(*keys, "y", "x", F.col("label").alias("t"))
    p = predicted.where("label > 0").select(*keys, "y", "x", F.col("label").alias("p"))
    inter = t.join(p, [*keys, "y", "x"]).groupBy(*keys, "t", "p").agg(F.count("*").alias("inter"))
    ta, pa_ = t.groupBy(*keys, "t").agg(F.count("*").alias("t_area")), p.groupBy(*keys, "p").agg(F.count("*").alias("p_area"))
    out = inter.join(ta, [*keys, "t"]).join(pa_, [*keys, "p"])
    return out.withColumns({"iou": F.col("inter") / (F.col("t_area") + F.col("p_area") - F.col("inter")), "dice": 2.0 * F.col("inter") / (F.col("t_area") + F.col("p_area"))})


def pixel_scores(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel-wise true and false positives and false negatives of foreground."""
    j = truth.select(*keys, "y", "x", (F.col("label") > 0).alias("t")).join(predicted.select(*keys, "y", "x", (F.col("label") > 0).alias("p")), [*keys, "y", "x"], "full").fillna(False, ["t", "p"])
    return j.groupBy(*keys).agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))


def nearest_centroid(points: DataFrame, keys: list[str], cell: float, label: str = "label") -> DataFrame:
    """Distance from every point (cy, cx) to its nearest other point within ``cell``; infinite if none is that near.

    Points meet those of their own and the eight cells around, by an equi-join on the cell.
    """
    p = points.withColumns({"__gy": F.floor(F.col("cy") / cell), "__gx": F.floor(F.col("cx") / cell)})
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    o = p.select(*keys, F.col(label).alias("__o"), F.col("cy").alias("__y"), F.col("cx").alias("__x"), "__gy", "__gx", steps)
    o = o.select(*keys, "__o", "__y", "__x", (F.col("__gy") + F.col("s.dy")).alias("__gy"), (F.col("__gx") + F.col("s.dx")).alias("__gx"))
    d = F.sqrt((F.col("cy") - F.col("__y")) ** 2 + (F.col("cx") - F.col("__x")) ** 2)
    met = p.join(o, [*keys, "__gy", "__gx"]).where(F.col(label) != F.col("__o")).withColumn("d", d).where(F.col("d") <= cell)
    near = met.groupBy(*keys, label).agg(F.min("d").alias("nearest"))
    return points.join(near, [*keys, label], "left").select(*keys, label, F.coalesce("nearest", F.lit(float("inf"))).alias("nearest"))


def label_at(points: DataFrame, pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Label under each point (px, py integers), else the nearest labelled pixel's within the radius; null if none.

    Every place near a labelled pixel is settled once, so the points meet a table of places, however many they are.
    """
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])).alias("s")
    near = pixels.where("label > 0").select(*keys, "y", "x", "label", steps)
    d2 = F.col("s.dy") * F.col("s.dy") + F.col("s.dx") * F.col("s.dx")
    places = near.groupBy(*keys, (F.col("y") + F.col("s.dy")).alias("py"), (F.col("x") + F.col("s.dx")).alias("px")).agg(F.min_by("label", F.struct(d2.alias("d2"), F.col("label"))).alias("label"))
    return points.join(places, [*keys, "py", "px"], "left")



def rasterise(circles: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of circles (cy, cx, radius, label); a pixel of several goes to the nearest centre, ties to the smaller label."""
    ys = F.explode(F.sequence(F.floor(F.col("cy") - F.col("radius")), F.ceil(F.col("cy") + F.col("radius")))).alias("y")
    xs = F.explode(F.sequence(F.floor(F.col("cx") - F.col("radius")), F.ceil(F.col("cx") + F.col("radius")))).alias("x")
    px = circles.select("*", ys).select("*", xs).withColumn("d2", (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2).where("d2 <= radius * radius")
    return px.groupBy(*keys, "y", "x").agg(F.min_by("label", F.struct("d2", "label")).alias("label"))


def stitched(tiles: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Overlapping tiles (keys, y0, x0, ty, tx, value) as one image: means where they overlap."""
    return tiles.groupBy(*keys, (F.col("y0") + F.col("ty")).alias("y"), (F.col("x0") + F.col("tx")).alias("x")).agg(F.avg(value).alias(value), F.count("*").alias("n_tiles"))


def tile_origins(height: Column, width: Column, tile: int, overlap: int) -> Column:
    """Origins of the tiles that cover an image: an array of (y0, x0); the last of a row or column ends at the edge."""
    step = tile - overlap

    def starts(n: Column) -> Column:
        last = F.greatest(n - tile, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda i: F.least(i * step, last)))

    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(y.alias("y0"), x.alias("x0")))))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost (shortest augmenting paths); rows or columns in excess stay alone."""
    if not cost.size:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    a = cost.T if flipped else cost
    n, m = a.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            gap = a[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], came[1:][better] = gap[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[came[j0]], came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def match_pairs(pairs: DataFrame, keys: list[str], a: str, b: str, score: str, least: float, greedy: bool = False, most_pairs: bool = False) -> DataFrame:
    """One-to-one matches of a and b per key among pairs of at least ``least`` score (and above 0).

    They have the largest total score; with ``most_pairs`` as many pairs as can be matched come first, then the score;
    with ``greedy`` pairs are taken by falling score, ties by a and b. Pairs are matched inside the connected components of
    the graph that they form, each of which is a task's group: what an image holds besides does not matter, and no matrix
    is larger than a component's. Of repeated pairs the best score counts.
    """
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in [*keys, a, b, score])
    use = pairs.where((F.col(score) >= least) & (F.col(score) > 0)).groupBy(*keys, a, b).agg(F.max(score).alias(score))
    # nodes by 64 bits of hash: two components that a collision joined would still be matched right
    use = use.withColumns({"__a": F.xxhash64(F.lit("a"), *keys, a), "__b": F.xxhash64(F.lit("b"), *keys, b)})
    use = staged(use, "pairs")
    parts = components(use, "__a", "__b").withColumnRenamed("node", "__a")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values([score, a, b], ascending=[False, True, True], kind="stable")
        if greedy:
            taken_a, taken_b, keep = set(), set(), []
            for i, (x, y) in enumerate(zip(df["__a"], df["__b"], strict=True)):
                if x not in taken_a and y not in taken_b:
                    taken_a.add(x)
                    taken_b.add(y)
                    keep.append(i)
            return df.iloc[keep][[*keys, a, b, score]]
        ra, ca = np.unique(df["__a"], return_inverse=True)
        rb, cb = np.unique(df["__b"], return_inverse=True)
        gain = np.zeros((len(ra), len(rb)))
        # a bonus above any total of scores puts the number of pairs first
        gain[ca, cb] = df[score] + (df[score].max() * min(gain.shape) + 1.0 if most_pairs else 0.0)
        chosen = np.zeros(gain.shape, bool)
        for i, j in assign(-gain):
            chosen[i, j] = gain[i, j] > 0
        return df[chosen[ca, cb]][[*keys, a, b, score]]

    return use.join(parts, "__a").groupBy("component").applyInPandas(solve, kinds)


def dense_labels(regions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Regions relabelled 1, 2, ... in a stable order."""
    return regions.withColumn("new_label", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def image_features(pixels: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Mean, deviation, skewness, percentiles and dark and bright shares of a channel."""
    v = F.col(channel)
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.01, 0.5, 0.99)]))
    return pixels.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.skewness(v).alias("skew"), q[0].alias("q01"), q[1].alias("q50"), q[2].alias("q99"), F.avg((v < 0.1).cast("int")).alias("dark"), F.avg((v > 0.9).cast("int")).alias("bright"))
