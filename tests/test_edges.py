"""Edge rules: missing values, ties, zero denominators, constant columns, missing controls."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from titerframe.functions import aggregates as A
from titerframe.functions import numeric as N
from titerframe.functions import text as T
from titerframe.operators import agreement, assay, gates, models, readouts, rois, sampling, spatial, statistics

NAN, INF = float("nan"), float("inf")


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_numeric_edges(spark):
    lit = lambda v: F.lit(v).cast("double")
    r = one(
        spark, nan_call=N.call(lit(NAN), 20.0), at=N.call(lit(20.0), 20.0), edge=N.borderline(lit(NAN)), ratio=N.safe_ratio(lit(1.0), lit(1e-13)), index=N.fluorescence_index(lit(5.0), lit(1.0), lit(None)),
        same=N.corrected_fraction(lit(5.0), lit(3.0), lit(3.0)), over=N.corrected_fraction(lit(500.0), lit(3.0), lit(13.0)), score=N.cdc_score(lit(NAN)), score8=N.cdc_score(lit(NAN), True), s10=N.cdc_score(lit(10.0)),
        low=N.rule_of(lit(-3.0)).score, none=N.rule_of(lit(NAN)), back=N.sinh_inverse(lit(1.0), lit(0.0)), cdf=N.normal_cdf(lit(1.96)), zero=N.zero_if_not_finite(lit(INF)),
    )
    assert (r.nan_call, r.at, r.edge) == ("not_available", "positive", False)
    assert r.ratio is None and r["index"] is None and r.same is None and r.over == 100.0
    assert (r.score, r.score8, r.s10, r.low, r.none, r.back, r.zero) == (None, 8, 1, 0, None, None, 0.0)
    assert abs(r.cdf - 0.5 * (1 + math.erf(1.96 / math.sqrt(2)))) < 2e-7
    p, q, f = N.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))
    assert tuple(one(spark, p=p, q=q, f=f)) == (1.0, 1.0, 1.0)


def test_text(spark):
    lit = F.lit
    r = one(spark, a=T.well_id(lit("1a")), b=T.well_id(lit("A 01")), c=T.well_id(lit("banner")), d=T.clean_cell(lit("  ")), e=T.locus(lit("DRB*")), f=T.base_name(lit("x\\y/z.tif")), g=T.inside(lit("../x")), h=T.inside(lit("a/b")), i=T.channel_role(lit(None).cast("string")))
    assert tuple(r) == ("A1", "A1", None, None, "DRB1", "z.tif", False, True, "marker")
    names = [x.n for x in spark.createDataFrame([("b10",), ("b9",), ("A2",)], "n string").orderBy(T.natural_key(F.col("n"))).collect()]
    assert names == ["A2", "b9", "b10"]


def test_quantiles_ignore_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (INF,), (None,)], "x double")
    r = df.agg(A.median(F.col("x")).alias("m"), A.sd(F.col("x")).alias("s"), A.mean(F.col("x")).alias("a")).first()
    assert r.m == 1.5 and r.a == 1.5 and abs(r.s - math.sqrt(0.5)) < 1e-12
    assert df.limit(0).agg(A.median(F.col("x")).alias("m")).first().m is None


def test_every_group_has_a_pool_from_all_of_its_parts(spark):
    rows = [(m, f, i, None if i == 3 else float(i)) for m, n in (("a", 300), ("b", 300), ("c", 5)) for f in range(10) for i in range(n)]
    df = spark.createDataFrame(rows, "marker string, file_id int, i int, value double")
    take = lambda d: sampling.pool_per_group(d, ["marker"], ["file_id"], ["i"], per_part=200, total=1000)
    got = take(df).collect()
    assert take(df).columns == df.columns and len(set(got)) == len(got) and set(map(tuple, got)) <= set(rows)
    by = {m: [r.file_id for r in got if r.marker == m] for m in "abc"}
    assert {m: len(x) for m, x in by.items()} == {"a": 1000, "b": 1000, "c": 50}
    assert all(60 < x.count(f) < 140 for x in (by["a"], by["b"]) for f in range(10))
    assert sorted(got, key=str) == sorted(take(df.repartition(7)).collect(), key=str)


def test_pools_leave_rows_beyond_their_end_where_they_are(spark):
    rows = [(m, f, i, float(i % 7)) for m, k in (("a", 1), ("b", 3)) for f, n in ((1, 900 * k), (2, 40), (None, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "marker string, file_id int, i int, value double").repartition(5)
    want = sampling.sample_per_group(df, ["marker", "file_id"], ["i"], 150)
    got = sampling.capped(df, ["marker", "file_id"], ["i"], 150)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 2 * (150 + 40 + 150)
    assert sampling.capped(df, ["marker", "file_id"], ["i"], 2700).count() == len(rows)

    pool = sampling.pool_per_group(df, ["marker"], ["file_id"], ["i"], per_part=150, total=100)
    h = F.xxhash64(F.lit(1), "file_id", "i")
    lowest = want.withColumn("r", F.row_number().over(Window.partitionBy("marker").orderBy(h, "file_id", "i"))).where("r <= 100").drop("r")
    assert sorted(pool.collect(), key=str) == sorted(lowest.collect(), key=str)
    # the only rows that are shuffled are those of the pool: no sort of all rows by part
    plan = sampling.pool_per_group(df, ["marker"], ["file_id"], ["i"], per_part=5000, total=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "SortMergeJoin" not in plan


def test_every_marker_is_calibrated_above_the_cap(spark):
    from titerframe.plans import catalog

    got = catalog.queries()["ml_marker_calibration"](spark, "/root/testdata/sf0.1").collect()
    assert {r.marker: r.n for r in got} == {"cd3": 120_000, "cd19": 120_000} and all(r.cofactor > 0 and math.isfinite(r.threshold) for r in got)


def test_constant_columns(spark):
    df = spark.createDataFrame([("f", 5.0)] * 20, "f string, x double")
    assert statistics.with_mad(df, ["f"], "x").first().mad == 0
    h = statistics.histogram(df, ["f"], "x", 8)
    assert h.count() == 8 and h.agg(F.sum("n")).first()[0] == 20


def test_histogram_counts_the_upper_edge(spark):
    df = spark.createDataFrame([("f", float(i)) for i in range(11)], "f string, x double")
    h = statistics.histogram(df, ["f"], "x", 10, 0.0, 1.0, pad=0.0)
    assert h.agg(F.sum("n")).first()[0] == 11 and h.where("bin = 9").first().n == 2


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("f", 1.0, 1.0), ("f", 2.0, 1.0), ("f", 3.0, 8.0), ("f", NAN, 9.0), ("f", 4.0, 0.0)], "f string, x double, w double")
    assert statistics.weighted_quantile(df, ["f"], "x", "w", 0.15).first()["quantile"] == 2.0


def test_edge_gate_is_open_and_null_safe(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (95.0,), (94.9,), (None,), (NAN,)], "x double")
    assert [r.g for r in df.select(gates.edge_gate(["x"], 100.0).alias("g")).collect()] == [False, True, False, True, False, False]


def test_few_events_keep_all_valid(spark):
    df = spark.createDataFrame([("f", 10.0 + i, 9.0 + i) for i in range(50)] + [("f", -1.0, 3.0)], "f string, a double, h double")
    out = gates.singlets_mad(df, "f", "a", "h")
    assert out.where("singlet").count() == 49 and out.count() == 51  # the lowest area is below the 2 % quantile


def test_missing_positive_control(spark):
    rows = [("g", "NC", float(i), float(i)) for i in range(10)] + [("g", "SAMPLE", 50.0, 50.0)]
    ev = spark.createDataFrame(rows, "gate string, role string, raw double, t double")
    c = readouts.control_stats(ev, "gate", "role", "raw", "t").first()
    assert (c.n_nc, c.n_pc, c.pc_median_raw) == (10, 0, None) and abs(c.cutoff - 8.1) < 1e-9
    r = readouts.readouts(ev.where("role = 'SAMPLE'"), ["role"], "gate", "raw", "t", readouts.control_stats(ev, "gate", "role", "raw", "t")).first()
    assert r.pos_fraction == 1.0 and r.fluorescence_index is None and r.median_shift == 45.5


def test_no_negative_control(spark):
    ev = spark.createDataFrame([("g", "SAMPLE", 1.0, 1.0)], "gate string, role string, raw double, t double")
    assert statistics.histogram_cutoff(ev, "gate", "role", "t").first().cutoff == 0.0


def test_well_without_decided_rois(spark):
    ro = spark.createDataFrame([("p", "A1", "sample", "uncertain")] * 3, "plate string, well string, role string, label string")
    w = rois.well_summary(ro, ["plate", "well", "role"])
    r = w.first()
    assert r.frac_pos_raw is None and r.frac_pos == 0.0 and r.frac_uncertain == 1.0
    c = assay.overlay(rois.corrected_wells(w, ["plate"]), None, ["plate", "well"])
    assert c.first().effective_call == "not_available"
    assert assay.panel_reactivity(c, ["plate"]).count() == 0 and assay.reactivity_score(c, ["plate"]).first().missing_wells == 1


def test_crossmatch_ties_go_to_manual_calls(spark):
    rows = [("s", "A1", 50.0, 50.0, "positive", False), ("s", "A2", 0.0, 0.0, "negative", True)]
    w = spark.createDataFrame(rows, "sample string, well string, corrected double, frac_pos_raw double, effective_call string, manual boolean")
    r = assay.crossmatch(w, ["sample"]).first()
    assert (r.final_call, r.call_source, r.discordant) == ("negative", "effective_well_calls", True)
    r = assay.crossmatch(w.withColumn("manual", F.lit(False)), ["sample"]).first()
    assert (r.final_call, r.call_source) == ("positive", "measured_mean")


def test_duplicate_keys_fail(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, n int")
    with pytest.raises(Exception, match="duplicate key"):
        agreement.join_counts({"a": df, "b": df}, ["k"]).collect()
    with pytest.raises(ValueError, match="schema"):
        agreement.merge_shards([df, df.withColumn("x", F.lit(1))], ["k"])


def test_compensation_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0)], "a double, b double")
    m = [[1.0, 0.2], [0.05, 1.0]]
    r = sampling.compensate(sampling.decompensate(df, ["a", "b"], m), ["a", "b"], m).first()
    assert abs(r.a - 10) < 1e-9 and abs(r.b - 20) < 1e-9
    assert sampling.parse_spill("2,A,B,1,0.1,0.2,1") == (["A", "B"], [[1.0, 0.1], [0.2, 1.0]]) and sampling.parse_spill("") is None


def test_mixture_finds_two_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 1, 1000)])
    w, m, c = models.fit_mixture(x, 2)
    assert abs(m[0, 0]) < 0.1 and abs(m[1, 0] - 6) < 0.15 and abs(w[0] - 0.75) < 0.02
    cut = models.intersection(w, m[:, 0], c[:, 0, 0])
    assert 2.9 < cut < 3.6
    raw = np.concatenate([np.abs(rng.normal(0, 150, 4000)), rng.normal(5000, 500, 2000)])
    cofactor, threshold = models.calibrate_marker(raw)
    assert 100 <= cofactor <= 2000 and np.arcsinh(600 / cofactor) < threshold < np.arcsinh(5000 / cofactor)
    assert math.isnan(models.calibrate_marker(np.array([]))[1])


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        cost = rng.random((n, m))
        pairs = spatial.assign(cost)
        small, large = min(n, m), max(n, m)
        best = min(sum((cost if n <= m else cost.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_neighbour_vote_share(spark):
    t = spark.createDataFrame([(i, [float(i), 0.0], i // 5) for i in range(10)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(100, [2.0, 0.0]), (101, [4.6, 0.0])], "id long, v array<double>")
    r = {x.id: x for x in models.neighbour_vote(q, t, "id", "v", "label", k=4).collect()}
    assert (r[100].predicted, r[100].prob) == (0, 1.0) and r[101].prob == 0.5
    with pytest.raises(ValueError):
        models.neighbour_vote(q, t, "id", "v", "label", max_training=3)


def test_tiles_cover_an_image(spark):
    got = [(r.y0, r.x0) for r in one(spark, t=spatial.tile_origins(F.lit(100), F.lit(64), 64, 16)).t]
    assert got == [(0, 0), (36, 0)]


def test_every_point_gets_the_label_of_its_own_place(spark):
    px = spark.createDataFrame([(0, y, x, 10 * y + x + 1) for y in range(3) for x in range(3)] + [(0, 9, 9, 0)], "image int, y int, x int, label long")
    points = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 2, 2), (0, 2, 4, 2), (0, 3, 9, 9), (1, 4, 0, 0)], "image int, point int, py int, px int")
    got = sorted((r.image, r.point, r.py, -1 if r.label is None else r.label) for r in spatial.label_at(points, px, ["image"], 2).collect())
    assert got == [(0, 1, 0, 1), (0, 1, 2, 23), (0, 2, 4, 23), (0, 3, 9, -1), (1, 4, 0, -1)]


def test_weighted_quantile_orders_only_the_range_that_holds_it(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), float(w)) for g in ("a", None) for v, w in zip(rng.permutation(3000) / 7, rng.integers(1, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    for q in (0.0, 0.3, 0.99, 1.0):
        out = statistics.weighted_quantile(df, ["g"], "x", "w", q)
        got = {r.g: r["quantile"] for r in out.collect()}
        for g in ("a", None):
            part = sorted((x, w) for k, x, w in rows if k == g)
            cw = np.cumsum([w for _, w in part])
            assert got[g] == part[int(np.argmax(cw >= q * cw[-1]))][0]
    assert "__part" in out._jdf.queryExecution().analyzed().toString()  # a value meets only what its range holds


def test_medians_of_plates_and_clusters_keep_no_group_in_a_task(spark):
    df = spark.range(2000).select(F.lit("p").alias("plate"), F.when(F.col("id") % 2 == 0, "positive").otherwise("negative").alias("role"), F.col("id").cast("double").alias("mean_r"), F.lit(1.0).alias("mean_g"))
    out = rois.calibrate_midpoint(df, ["plate"])
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert abs(r.pc - 999.0) < 1e-6 and abs(r.nc - 1000.0) < 1e-6
    ev = spark.range(900).select((F.col("id") % 3).alias("c"), (F.col("id") % 100).cast("double").alias("f"), (F.col("id") % 50).cast("double").alias("s"), F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.0).alias("m"))
    out = models.label_clusters(ev, "c", {"m": 1.0}, "f", "s")
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.cluster, x.n, x.population) for x in out.collect()) == [(0, 300, "m"), (1, 300, "Unknown"), (2, 300, "Unknown")]
