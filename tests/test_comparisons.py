"""Tiles joined to images, centres against heat maps, loaders and texts against brute force; the fuller views."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.functions import text as T
from titerframe.operators import comparisons as C
from titerframe.operators import models, reports, spatial


def pixels(spark, maps, name="label", kind="long"):
    return spark.createDataFrame([(i, int(y), int(x), v.item()) for i, m in maps.items() for (y, x), v in np.ndenumerate(m)], f"image long, y int, x int, {name} {kind}")


def test_tile_union_counts_every_pixel_once(spark):
    rng = np.random.default_rng(1)
    tiles = [(i, y0, x0, rng.random((8, 9)) < 0.5, rng.random((8, 9)) < 0.5, rng.random((8, 9)) < 0.8) for i in (1, 2) for y0, x0 in ((0, 0), (3, 4), (3, 0), (5, 5))]
    rows = [(i, y0, x0, int(y), int(x), bool(t[y, x]) if (y, x) != (0, 0) else None, bool(p[y, x])) for i, y0, x0, t, p, r in tiles for y, x in np.argwhere(r)]
    got = {r.image: r for r in C.tile_union(spark.createDataFrame(rows, "image long, y0 int, x0 int, ty int, tx int, truth boolean, predicted boolean"), ["image"], height=13, width=14).collect()}
    for image in (1, 2):
        seen, gt, pred = (np.zeros((13, 14), bool) for _ in range(3))
        overlap = tc = pc = 0
        for i, y0, x0, t, p, r in sorted(tiles, key=lambda v: v[:3]):
            if i != image:
                continue
            t = t.copy()
            t[0, 0] = False
            for y, x in np.argwhere(r):
                at = (y0 + y, x0 + x)
                if seen[at]:
                    overlap += 1
                    tc += gt[at] != t[y, x]
                    pc += pred[at] != p[y, x]
                else:
                    pred[at] = p[y, x]
                gt[at] |= t[y, x]
                seen[at] = True
        tp, fp, fn = (seen & gt & pred).sum(), (seen & ~gt & pred).sum(), (seen & gt & ~pred).sum()
        r = got[image]
        assert (r.tp, r.fp, r.fn, r.evaluated, r.overlap, r.truth_conflicts, r.predicted_conflicts) == (tp, fp, fn, seen.sum(), overlap, tc, pc)
        assert r.dice == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r.coverage == pytest.approx(seen.mean())


def flooded(mask):
    left, n = {tuple(p) for p in np.argwhere(mask)}, 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a, b in itertools.product((-1, 0, 1), repeat=2)} & left
            left -= near
            todo += near
    return n


def test_parts_of_masks_and_prediction_rows(spark):
    rng = np.random.default_rng(2)
    truth = {i: (rng.random((14, 14)) < 0.35) * rng.integers(1, 5, (14, 14)) for i in range(3)}
    predicted = {i: (rng.random((14, 14)) < (0.3 if i else 0.0)) * 1 for i in range(3)}
    heat = {i: np.round(rng.random((14, 14)), 3) for i in range(3)}
    t, p, h = pixels(spark, truth), pixels(spark, predicted), pixels(spark, heat, "v", "double")
    assert {r.image: r.n_components for r in C.mask_components(p, ["image"]).collect()} == {i: flooded(m > 0) for i, m in predicted.items() if m.any()}
    for r in C.prediction_rows(t, p, h, ["image"], "v", 0.9, 2).collect():
        a, b, v = truth[r.image], predicted[r.image], heat[r.image]
        tops = sum(v[y, x] >= 0.9 and v[y, x] == v[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for y, x in np.ndindex(v.shape))
        n = len(np.unique(a[a > 0]))
        assert (r.n_components, r.n_centres, r.count_error_components, r.abs_count_error_centres) == (flooded(b > 0), tops, flooded(b > 0) - n, abs(tops - n))
        assert r.jaccard == pytest.approx((((a > 0) & (b > 0)).sum()) / ((a > 0) | (b > 0)).sum())


def test_centre_metrics_over_thresholds(spark):
    rng = np.random.default_rng(3)
    label, heat = np.zeros((30, 30), int), np.round(rng.random((30, 30)) * 0.4, 3)
    for k, (cy, cx) in enumerate([(5, 5), (6, 20), (15, 12), (24, 24), (25, 4)], 1):
        label[cy - 2 : cy + 3, cx - 1 : cx + 2] = k
        if k != 4:
            heat[cy + k % 2, cx] = 0.5 + k / 10
    heat[29, 15] = 0.75
    maps, thresholds = {1: label, 2: np.zeros((30, 30), int)}, (0.2, 0.3, 0.55, 0.65, 0.9)
    got = {r.image: r for r in C.centre_metrics(pixels(spark, {1: heat, 2: heat * 0}, "v", "double"), pixels(spark, maps), ["image"], "v", 0.55, 3, 4.0, thresholds).collect()}
    peaks = [(y, x) for y, x in np.ndindex(heat.shape) if heat[y, x] >= 0.2 and heat[y, x] == heat[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].max()]
    centres = [tuple(int(v) for v in np.argwhere(label == k).mean(0)) for k in range(1, 6)]

    def matched(threshold):
        use = [p for p in peaks if heat[p] >= threshold]
        d = np.array([[math.dist(p, g) for g in centres] for p in use]).reshape(len(use), 5)
        gain = np.where(d <= 4, 100 - d, 0)
        return len(use), sorted(d[i, j] for i, j in spatial.assign(-gain) if d[i, j] <= 4)

    n, d = matched(0.55)
    r = got[1]
    assert (r.n_pred, r.n_gt, r.n_tp) == (n, 5, len(d)) and r.loc_mean == pytest.approx(np.mean(d))
    curve = sorted((len(m) / (5 + 1e-8), -len(m) / (k + 1e-8)) for k, m in map(matched, thresholds))
    assert r.ap == pytest.approx(sum((b[0] - a[0]) * -(b[1] + a[1]) / 2 for a, b in zip(curve, curve[1:], strict=False)))
    similar = [math.exp(-v * v / (2 * 0.25 * 15)) for v in d]
    for limit, value in ((0.5, r.oks_0p5), (0.75, r.oks_0p75), (0.9, r.oks_0p9)):
        assert value == pytest.approx(np.mean([s >= limit for s in similar]))
    assert (got[2].n_pred, got[2].n_gt, got[2].n_tp, got[2].ap, got[2].loc_mean, got[2].oks_map) == (0, 0, 0, 0.0, None, None)


def test_loaders_and_modes(spark):
    df = spark.createDataFrame([(1, "a", 5, 0), (1, "a", 9, 10), (2, "a", None, 4), (2, "b", 3, 2)], "idx int, src_path string, count_error_instances int, n_cells_per_img int")
    once = C.first_of_keys(df, ["idx", "src_path", "none"], ["n_cells_per_img"])
    got = {(r.idx, r.src_path): r.count_error_pct for r in C.count_error_percent(once, ["x", "count_error_instances"], ["n_cells_per_img"]).collect()}
    assert got == {(1, "a"): None, (2, "a"): None, (2, "b"): 150.0} and C.first_of_keys(df, ["none"], ["idx"]).count() == 4
    assert C.count_error_percent(df, ["x"], ["y"]).where("count_error_pct IS NULL").count() == 4
    with pytest.raises(ValueError, match="missing"):
        C.annotator_rows(df, "m", {}, ["score"])
    modes = spark.createDataFrame([(1, "T"), (10, "T/B")], "col int, mode string")
    assert C.checked_modes(modes).count() == 2
    for bad in ((0, "T"), (11, "B"), (3, "X"), (None, "T"), (3, None)):
        with pytest.raises(Exception, match="column"):
            C.checked_modes(spark.createDataFrame([bad], "col int, mode string")).collect()
    files = spark.createDataFrame([("m/tiles_epoch12.pt",), ("m/tiles-Epoch_3.pt",), ("m/pad_epoch5.pt",), ("m/tiles.pt",)], "p string")
    assert {r.p for r in C.checkpoints(files, "p", "tiles", ["tiles", "pad"], include=[3, 12], high=10).collect()} == {"m/tiles-Epoch_3.pt"}
    assert C.checkpoints(files, "p").count() == 4
    with pytest.raises(ValueError):
        C.checkpoints(files, "p", "none", ["tiles"])


def test_report_texts(spark):
    df = spark.createDataFrame([(1.234, 1.0, 2.0, None), (float("nan"), None, None, 3.0), (None, None, None, None)], "v double, lo double, hi double, s double")
    got = [tuple(r) for r in df.select(T.formatted(F.col("v"), 1), T.percent_with_range(F.col("v"), F.col("lo"), F.col("hi"), F.col("s"))).collect()]
    assert got == [("1.2", "1.2% (range: 1.0-2.0%)"), ("-", "- (range: 3.0%)"), ("-", "-")]
    raw = spark.createDataFrame([(bytearray(b" \xe9t\xe9 "),), (bytearray("été".encode()),), (None,)], "b binary")
    assert [r[0] for r in raw.select(T.decoded(F.col("b"))).collect()] == ["été", "été", ""]
    gates = spark.createDataFrame([(g,) for g in ("cd3", "Lymphocytes", "B cells", "All Cells", "Singlets", None)], "g string")
    assert [r.g for r in gates.orderBy(T.gate_rank(F.col("g"))).collect()][:5] in (["All Cells", "Singlets", "Lymphocytes", None, "B cells"], ["All Cells", "Singlets", "Lymphocytes", "B cells", "cd3"])


def test_spill_rows_and_votes_without_the_row_itself(spark):
    texts = spark.createDataFrame([("f", "2, FITC ,PE,1,0.5, 0.25,1"), ("g", None), ("h", "2,A,B,1"), ("i", ""), ("j", "x,1")], "file string, t string")
    got = [tuple(r) for r in reports.spill_rows(texts, ["file"], "t").collect()]
    assert got == [("f", "FITC", "FITC", 1.0), ("f", "FITC", "PE", 0.5), ("f", "PE", "FITC", 0.25), ("f", "PE", "PE", 1.0)]
    rows = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "b"), (3, [0.2], "b"), (4, [5.0], "c")], "id long, v array<double>, l string")
    votes = {r.id: r.predicted for r in models.neighbour_vote(rows, rows, "id", "v", "l", k=1, without_self=True).collect()}
    assert votes == {1: "b", 2: "a", 3: "b", 4: "b"}
    assert {r.id: r.predicted for r in models.neighbour_vote(rows, rows, "id", "v", "l", k=1).collect()} == {1: "a", 2: "b", 3: "b", 4: "c"}
