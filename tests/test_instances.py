"""Matching inside components, instance scores and peaks against brute force over dense arrays."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from titerframe.operators import graphs, instances, reports, spatial

SIZE = 24


def blobs(rng, n, noise=0):
    """A label map of overlapping disks of different sizes, with holes."""
    out = np.zeros((SIZE, SIZE), int)
    for label in range(1, n + 1):
        cy, cx, r = rng.uniform(0, SIZE), rng.uniform(0, SIZE), rng.uniform(1.5, 4.5)
        y, x = np.mgrid[:SIZE, :SIZE]
        out[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = label
    out[rng.random(out.shape) < noise] = 0
    return out


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(7)
    truth = {i: blobs(rng, 9) for i in range(4)}
    predicted = {i: np.where(rng.random((SIZE, SIZE)) < 0.1, 0, np.roll(truth[i], rng.integers(-2, 3), 1)) for i in range(4)}
    predicted[1] = blobs(rng, 14)
    truth |= {4: np.zeros((SIZE, SIZE), int), 5: blobs(rng, 3), 6: np.zeros((SIZE, SIZE), int)}
    predicted |= {4: np.zeros((SIZE, SIZE), int), 5: np.zeros((SIZE, SIZE), int), 6: blobs(rng, 2)}
    ring = np.zeros((SIZE, SIZE), int)
    ring[4:13, 4:13] = 1
    ring[6:11, 6:11] = 0
    truth[7], predicted[7] = ring, np.where(ring > 0, 5, 0)
    return truth, predicted


def as_table(spark, maps):
    return spark.createDataFrame([(i, int(y), int(x), int(v)) for i, m in maps.items() for (y, x), v in np.ndenumerate(m)], "image long, y int, x int, label long")


def pairs_of(t, p):
    out = {}
    for a in np.unique(t[t > 0]):
        for b in np.unique(p[(t == a) & (p > 0)]):
            inter, union = ((t == a) & (p == b)).sum(), ((t == a) | (p == b)).sum()
            out[int(a), int(b)] = (inter / union, int(inter), int(union))
    return out


def best_match(score: dict) -> dict:
    """As many pairs as can be, then the largest total, over the whole dense matrix."""
    rows, cols = sorted({a for a, _ in score}), sorted({b for _, b in score})
    gain = np.zeros((len(rows), len(cols)))
    for (a, b), s in score.items():
        gain[rows.index(a), cols.index(b)] = s + min(len(rows), len(cols)) + 1
    return {(rows[i], cols[j]): score[rows[i], cols[j]] for i, j in spatial.assign(-gain) if gain[i, j] > 0}


def rates(tp, fp, fn):
    if tp + fp + fn == 0:
        return 1.0, 1.0, 1.0
    return tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0, 2 * tp / (2 * tp + fp + fn)


def test_object_scores_at_all_thresholds(spark, maps):
    truth, predicted = maps
    rows = {(r.image, r.threshold): r for r in instances.object_scores(as_table(spark, truth), as_table(spark, predicted), ["image"]).collect()}
    assert len(rows) == len(truth) * 7
    for i, t in truth.items():
        p = predicted[i]
        nt, np_, pairs = len(np.unique(t[t > 0])), len(np.unique(p[p > 0])), pairs_of(t, p)
        for threshold in reports.IOU_THRESHOLDS:
            m = best_match({k: v[0] for k, v in pairs.items() if v[0] >= threshold})
            r, iou = rows[i, threshold], sum(m.values())
            dice = sum(2 * v / (1 + v) for v in m.values())
            assert (r.tp, r.fp, r.fn) == (len(m), np_ - len(m), nt - len(m))
            assert (r.precision, r.recall, r.f1) == pytest.approx(rates(r.tp, r.fp, r.fn))
            assert r.pq == pytest.approx(iou / (r.tp + r.fp / 2 + r.fn / 2) if nt + np_ else 1.0)
            assert (r.mean_iou, r.mean_dice) == ((None, None) if not m else (pytest.approx(iou / len(m)), pytest.approx(dice / len(m))))
            assert (r.mean_iou_all, r.mean_dice_all) == (pytest.approx(iou / nt), pytest.approx(dice / nt)) if nt else (1.0 if not np_ else 0.0,) * 2


def test_aggregated_jaccard_and_matched_dice(spark, maps):
    truth, predicted = maps
    rows = {r.image: r for r in instances.aggregated_jaccard(as_table(spark, truth), as_table(spark, predicted), ["image"]).collect()}
    for i, t in truth.items():
        p = predicted[i]
        pairs = pairs_of(t, p)
        m = best_match({k: v[0] for k, v in pairs.items()})
        left = [(t == a).sum() for a in np.unique(t[t > 0]) if a not in {k[0] for k in m}] + [(p == b).sum() for b in np.unique(p[p > 0]) if b not in {k[1] for k in m}]
        both = t.any() and p.any()
        want = sum(pairs[k][1] for k in m) / (sum(pairs[k][2] for k in m) + sum(left)) if both else float(not t.any() and not p.any())
        assert rows[i].aji == pytest.approx(want)
        assert rows[i].matched_dice == (pytest.approx(np.mean([2 * pairs[a, b][1] / ((t == a).sum() + (p == b).sum()) for a, b in m])) if m else None)


def test_centres_in_masks_and_within_radii(spark, maps):
    truth, predicted = maps
    inside = {r.image: r for r in instances.centre_in_mask(as_table(spark, truth), as_table(spark, predicted), ["image"]).collect()}
    near = {(r.image, r.radius): r for r in instances.centre_scores(as_table(spark, truth), as_table(spark, predicted), ["image"]).collect()}
    for i, t in truth.items():
        p, hit, centres = predicted[i], set(), {}
        for a in np.unique(t[t > 0]):
            ys, xs = np.nonzero(t == a)
            cy, cx = ys.mean(), xs.mean()
            y, x = int(np.rint(cy)), int(np.rint(cx))
            if t[y, x] != a:
                k = ((ys - cy) ** 2 + (xs - cx) ** 2).argmin()
                y, x = ys[k], xs[k]
            hit |= {p[y, x]} - {0}
            centres[a] = (cy, cx)
        others = {b: tuple(np.argwhere(p == b).mean(0)) for b in np.unique(p[p > 0])}
        assert (inside[i].tp, inside[i].fp, inside[i].fn) == (len(hit), len(others) - len(hit), len(centres) - len(hit))
        for radius in instances.CENTRE_RADII:
            d = {(a, b): np.hypot(ca[0] - cb[0], ca[1] - cb[1]) for a, ca in centres.items() for b, cb in others.items()}
            m = best_match({k: 1 - v / (radius + 1) for k, v in d.items() if v <= radius})
            r = near[i, radius]
            assert (r.tp, r.fp, r.fn) == (len(m), len(others) - len(m), len(centres) - len(m))
            assert r.mean_error == (pytest.approx(np.mean([d[k] for k in m])) if m else None)


def edge_of(mask):
    out = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        around = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out[y, x] = not all(0 <= a < SIZE and 0 <= b < SIZE and mask[a, b] for a, b in around)
    return out


@pytest.mark.parametrize("tolerance", [0, 2, 3])
def test_boundaries_within_a_tolerance(spark, maps, tolerance):
    truth, predicted = maps
    rows = {r.image: r for r in instances.boundary_scores(as_table(spark, truth), as_table(spark, predicted), ["image"], tolerance).collect()}
    for i, t in truth.items():
        a, b = np.argwhere(edge_of(t > 0)), np.argwhere(edge_of(predicted[i] > 0))
        if not len(a) or not len(b):
            want = (float(not len(a) and not len(b)),) * 3
        else:
            d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
            pr, rc = (d.min(0) <= tolerance).mean(), (d.min(1) <= tolerance).mean()
            want = pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        assert (rows[i].precision, rows[i].recall, rows[i].f1) == pytest.approx(want)


def test_a_row_of_all_scores(spark, maps):
    truth, predicted = maps
    rows = instances.comparison(as_table(spark, truth), as_table(spark, predicted), ["image"]).collect()
    assert sorted(r.image for r in rows) == sorted(truth)
    same = next(r for r in rows if r.image == 7)
    assert same.aji == same.instance_f1_0p9 == same.center_f1_4 == same.center_in_mask_f1 == same.boundary_f1 == 1.0


def test_splits_and_merges_of_sides_that_share_nothing(spark):
    a = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 1), (2, 0, 1, 1)], "image long, y int, x int, label long")
    b = spark.createDataFrame([(1, 5, 5, 1), (2, 0, 0, 1), (2, 0, 1, 2), (3, 0, 0, 4)], "image long, y int, x int, label long")
    assert sorted(map(tuple, reports.splits_and_merges(a, b, ["image"]).collect())) == [(1, 0, 0), (2, 1, 0), (3, 0, 0)]


# ----------------------------------------------------------------------------------------------- components, matching


def test_components_of_a_long_chain_take_few_rounds(spark):
    rng = random.Random(9)
    names = [f"n{k:05d}" for k in rng.sample(range(99_999), 5000)]
    edges = list(zip(names, names[1:], strict=False)) + [("z", "z"), ("y", None), (names[7], names[2])]
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a string, b string"), "a", "b", rounds=19).collect()}
    assert found == dict.fromkeys(names, min(names)) | {"z": "z"}
    with pytest.raises(RuntimeError):
        graphs.components(spark.createDataFrame(edges, "a string, b string"), "a", "b", rounds=2)


def test_components_of_sorted_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(600)] + [(5000, 5000 + i) for i in range(1, 300)] + [(9000 + i, 9000) for i in range(1, 40)]
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {n: 0 if n < 5000 else 5000 if n < 9000 else 9000 for e in edges for n in e}
    assert graphs.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("most_pairs", [False, True])
def test_matching_inside_components_is_the_best_of_all_assignments(spark, most_pairs):
    rng = random.Random(3)
    rows = [(g, a, b, rng.choice([0.05, 0.2, 0.5, 0.5, 0.9])) for g in (1, 2, 3) for a in range(5) for b in range(5) if rng.random() < 0.45] + [(1, 0, 0, 0.01), (4, None, 1, 0.7)]
    df = spark.createDataFrame(rows, "g int, a int, b int, s double")
    got = spatial.match_pairs(df, ["g"], "a", "b", "s", 0.1, most_pairs=most_pairs).collect()
    for g in (1, 2, 3):
        score = {}
        for k, a, b, s in rows:
            if k == g and s >= 0.1:
                score[a, b] = max(s, score.get((a, b), 0))
        best = (-1, -1.0)
        for order in itertools.permutations(range(5)):
            for use in range(32):
                m = [(a, b) for a, b in enumerate(order) if use >> a & 1 and (a, b) in score]
                total = sum(score[p] for p in m)
                best = max(best, (len(m) if most_pairs else 0, total))
        mine = [r for r in got if r.g == g]
        assert len({r.a for r in mine}) == len({r.b for r in mine}) == len(mine)
        assert (len(mine) if most_pairs else 0, pytest.approx(sum(r.s for r in mine))) == best


# --------------------------------------------------------------------------------------------------------------- peaks


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_peaks_are_those_of_a_maximum_filter(spark, distance):
    rng = np.random.default_rng(distance)
    images = {i: np.round(rng.random((18, 21)), 2) for i in range(3)}
    images[1][3:6, 4:7], images[2][:] = 0.995, 0.6
    rows = [(i, int(y), int(x), float(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(m) if (i, y, x) != (0, 2, 2)] + [(0, 40, 40, None), (0, 41, 41, float("nan"))]
    got = {(r.image, r.y, r.x): (r.score, (r.plateau_y, r.plateau_x)) for r in instances.peaks(spark.createDataFrame(rows, "image long, y int, x int, v double"), ["image"], "v", 0.5, distance).collect()}
    want = {}
    for i, m in images.items():
        m = m.copy()
        if i == 0:
            m[2, 2] = -1
        top = np.array([[m[max(0, y - distance) : y + distance + 1, max(0, x - distance) : x + distance + 1].max() for x in range(21)] for y in range(18)])
        mask = (m >= 0.5) & ((m == top) if distance > 1 else True)
        first = {tuple(p): tuple(p) for p in np.argwhere(mask)}
        changed = True
        while changed:
            changed = False
            for (y, x), f in first.items():
                for a, b in itertools.product((-1, 0, 1), repeat=2):
                    q = (y + a, x + b)
                    if q in first and m[q] == m[y, x] and first[q] < first[y, x]:
                        first[y, x], changed = first[q], True
        want |= {(i, *map(int, p)): (float(m[p]), tuple(map(int, f))) for p, f in first.items()}
    assert got == want
