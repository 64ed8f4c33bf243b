"""Mixture gates against plain NumPy over whole files, and the calibration of markers."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest

from titerframe.operators import mixture_gates as G
from titerframe.operators import models


def file_of(rng, name, n, share, noise=0.02):
    """Singlets of large area, doublets off the diagonal, debris; two scatter groups, the larger one marker positive."""
    big = rng.random(n) < share
    a = np.where(big, rng.lognormal(10.6, 0.12, n), rng.lognormal(9.2, 0.3, n))
    h = a * np.where(rng.random(n) < 0.1, 0.6, 1.0) * rng.lognormal(0, noise, n)
    s = np.where(big, rng.lognormal(9.0, 0.2, n), rng.lognormal(9.8, 0.4, n))
    return pd.DataFrame({"file": name, "i": np.arange(n), "a": a, "h": h, "s": s, "m": big & (rng.random(n) < 0.8)})


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    one = file_of(rng, "one", 1500, 0.7)
    one.loc[:5, "a"] = 0.0
    one.loc[6:8, "h"] = np.nan
    flat = file_of(rng, "flat", 700, 0.5, 0.0)
    flat["h"] = flat["a"]
    return pd.concat([one, file_of(rng, "two", 900, 0.3), file_of(rng, "few", 120, 0.6), file_of(rng, "tilt", 800, 0.99), flat], ignore_index=True)


def candidates(part):
    positive = (part.a > 1e-12) & (part.h > 1e-12)
    return (positive & (part.a >= np.quantile(part.a[positive], 0.02))).to_numpy()


def in_band(r, k):
    med = np.median(r)
    mad = np.median(np.abs(r - med))
    return mad, (r >= med - k * mad) & (r <= med + k * mad)


def mixture(part):
    valid = candidates(part)
    out, a, h = valid.copy(), np.log1p(part.a.to_numpy())[valid], np.log1p(part.h.to_numpy())[valid]
    if valid.sum() < 500:
        return valid, out
    x = np.column_stack([a, h])
    resp = models.responsibilities(x, models.fit_mixture(part_order(part, valid), 2, tied=True))
    hard = resp.argmax(1)
    meds = np.array([np.median(a[hard == j]) if (hard == j).any() else -np.inf for j in range(2)])
    lean = [abs(np.linalg.eigh(np.cov(x[hard == j].T))[1][:, -1].sum()) if (hard == j).sum() > 1 else -1.0 for j in range(2)]
    pick = max((j for j in range(2) if meds[j] >= meds.max() - 0.05), key=lambda j: (lean[j], -j))
    for keep in (resp[:, pick] >= 0.8, hard == pick):
        if 0.05 <= keep.mean() <= 0.98:
            out[valid] = keep
            break
    return valid, out


def part_order(part, valid):
    """All candidates (the sample is the file here); the fit doesn't depend on their order beyond rounding."""
    return np.column_stack([np.log1p(part.a.to_numpy())[valid], np.log1p(part.h.to_numpy())[valid]])


def plain_mad(part):
    valid = candidates(part)
    r = np.log1p(part.h.to_numpy()[valid]) - np.log1p(part.a.to_numpy()[valid])
    mad, band = in_band(r, 4.0)
    out = valid.copy()
    if valid.sum() >= 300 and mad > 0:
        out[valid] = band
    return out


def hybrid(part):
    valid, first = mixture(part)
    if not 0.05 <= first[valid].mean() <= 0.98:
        return plain_mad(part)
    r = np.log1p(part.h.to_numpy()[first]) - np.log1p(part.a.to_numpy()[first])
    if len(r) < 300:
        return first
    mad, band = in_band(r, 3.5)
    out = first.copy()
    if mad > 0 and 0.50 <= band.mean() <= 0.999:
        out[first] = band
    return out


def guided(part, cfg):
    qc = (part.a > 0).to_numpy()
    f, s, lead = np.log1p(part.a.to_numpy()[qc]), np.log1p(part.s.to_numpy()[qc]), part.m.to_numpy()[qc]
    keep = np.ones(qc.sum(), bool)
    if lead.sum() >= cfg.min_guide:
        large = lead.copy()
        if lead.sum() >= cfg.min_low_fit:
            large[lead] = models.responsibilities(f[lead], models.fit_mixture(f[lead], 2))[:, 1] >= 0.5
        lead = large if large.sum() >= cfg.min_guide else lead
        x = np.column_stack([f, s])
        resp = models.responsibilities(x, models.fit_mixture(x, cfg.components))
        sums, p, covered = resp[lead].sum(0), 0.0, 0.0
        for j in np.argsort(-sums, kind="stable"):
            p, covered = p + resp[:, j], covered + sums[j] / sums.sum()
            if covered >= cfg.coverage:
                break
        keep = p >= cfg.least_resp if (p >= cfg.least_resp).mean() >= cfg.min_keep else keep
    a, z = part.a.to_numpy()[qc], part.s.to_numpy()[qc]
    out = qc.copy()
    out[qc] = keep & (a >= np.quantile(a, cfg.fsc_q)) & (z <= np.quantile(z, cfg.ssc_q))
    return out


def masks(df, out):
    return df.select("file", "i", out).toPandas().groupby("file").apply(lambda g: set(g.i[g[out]]), include_groups=False).to_dict()


def expected(table, rule):
    return {name: set(part.i.to_numpy()[rule(part)]) for name, part in table.groupby("file")}


def test_mixture_gate(spark, table):
    got = masks(G.singlets_mixture(spark.createDataFrame(table), "file", ["i"], "a", "h"), "singlet")
    assert got == expected(table, lambda p: mixture(p)[1])
    assert 500 < len(got["one"]) < 1500 and len(got["few"]) < 120  # a real cut, and a file kept but for its smallest


def test_hybrid_gate(spark, table):
    got = masks(G.singlets_hybrid(spark.createDataFrame(table), "file", ["i"], "a", "h"), "singlet")
    assert got == expected(table, hybrid)
    first = expected(table, lambda p: mixture(p)[1])
    assert any(got[f] < first[f] for f in got)  # a band inside the mixture


def test_guided_lymphocytes(spark, table):
    from pyspark.sql import functions as F

    cfg = G.GuideConfig(min_guide=200, min_low_fit=300)
    got = masks(G.lymphocytes_guided(spark.createDataFrame(table), "file", ["i"], F.col("a") > 0, F.col("m"), "a", "s", cfg=cfg), "lymph")
    assert got == expected(table, lambda p: guided(p, cfg))
    rails = expected(table, lambda p: guided(p, G.GuideConfig(min_guide=10_000)))
    assert got["one"] < rails["one"] and got["flat"] < rails["flat"]  # cut by the guide
    assert got["two"] == rails["two"] and got["few"] == rails["few"]  # 199 and 49 guide events: rails alone


def test_guided_lymphocytes_of_files_that_end_inside_a_batch(spark, table, monkeypatch):
    from pyspark.sql import functions as F

    gated = lambda: masks(G.lymphocytes_guided(spark.createDataFrame(table), "file", ["i"], F.col("a") > 0, F.col("m"), "a", "s"), "lymph")
    want = gated()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(G, "HELD", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert gated() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_events_move_once_around_the_guide_and_for_the_pool(spark, table):
    from pyspark.sql import functions as F

    from titerframe.operators.reports import training_pool

    df = spark.createDataFrame(table)
    lymph = G.lymphocytes_guided(df, "file", ["i"], F.col("a") > 0, F.col("m"), "a", "s")
    pool = training_pool(df, "file", ["i"], F.col("m"), ["a", "s"], 40, tail=5, least=50)
    for out in (lymph, pool):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert pool.columns == df.columns and pool.count() > 40


def test_a_staged_table_leaves_no_shuffle_files(spark, table):
    from titerframe.operators.staging import staged, unstaged

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    out = staged(spark.createDataFrame(table).groupBy("file").count())
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before and out.count() == table.file.nunique()
    unstaged(out)


def test_empty_tables_and_null_rows(spark):
    from pyspark.sql import functions as F

    schema = "file string, i long, a double, h double, s double, m boolean"
    for rows in ([], [(None, 1, None, None, None, None), ("x", None, float("nan"), 1.0, float("inf"), True)]):
        df = spark.createDataFrame(rows, schema)
        for gated in (G.singlets_mixture(df, "file", ["i"], "a", "h"), G.singlets_hybrid(df, "file", ["i"], "a", "h")):
            assert [r.singlet for r in gated.collect()] == [False] * len(rows)
        lymph = G.lymphocytes_guided(df, "file", ["i"], F.col("a") > 0, F.col("m"), "a", "s")
        assert [r.lymph for r in lymph.collect()] == [False] * len(rows)


def test_calibration_refits_at_the_final_cofactor():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(60, 40, 4000), rng.normal(3000, 500, 2000), [np.nan]])
    c, t = models.calibrate_marker(x)
    v = np.clip(np.arcsinh(x[:-1] / c), -8, 8)
    w, m, s = models.fit_mixture(v, 2)
    assert t == pytest.approx(models.intersection(w, m[:, 0], s[:, 0, 0]))
    background = models.responsibilities(v, (w, m, s))[:, 0]
    order = np.argsort(v, kind="stable")
    edge = v[order][np.searchsorted(np.cumsum(background[order]), 0.99 * background.sum())]
    assert c * math.sinh(edge) / math.sinh(1.0) == pytest.approx(c, rel=0.05)


def test_calibration_of_one_population_takes_the_lower_half():
    x = np.random.default_rng(6).normal(900, 5, 5000)
    c, t = models.calibrate_marker(x)
    assert c == pytest.approx(np.quantile(x[x <= np.median(x)], 0.99) / math.sinh(1.0)) and np.isfinite(t)
    assert models.calibrate_marker(x[:50])[0] == 150.0


def test_mixtures_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(8)
    parts = [np.concatenate([rng.normal(0, 1, (n, 2)), rng.normal(3, 0.5, (n // 2, 2))]) for n in (40, 300, 900, 310, 5, 320, 41)]
    for k, tied in ((3, False), (2, True)):
        for x, model in zip(parts, models.fit_mixtures(parts, k, tied=tied), strict=True):
            assert all(np.allclose(a, b, rtol=1e-9, atol=1e-9) for a, b in zip(model, models.fit_mixture(x, k, tied=tied), strict=True))


def test_scores_of_a_mixture_are_computed_in_batches(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(4, 1, (100, 2))])
    model = models.fit_mixture(x, 2)
    flat = G._flat(model)
    rows = [(float(a), float(b), flat if i % 7 else None, i % 5 > 0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, m array<double>, ok boolean")
    out = G._with_responsibilities(df, [("r", "m", 2, ["a", "b"], "ok")])
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = models.responsibilities(x, model)
    for row, w in zip(out.collect(), want, strict=True):
        assert (row.r is None) == (row.m is None or not row.ok) and (row.r is None or np.allclose(row.r, w, atol=1e-9))
