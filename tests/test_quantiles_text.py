"""Exact quantiles at every size, cutoffs with few events, text helpers, signed ranks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.functions import numeric
from titerframe.functions import text as T
from titerframe.operators import agreement, statistics

QS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def test_exact_quantiles_of_groups_of_every_size(spark):
    rng = random.Random(1)
    groups = {n: [rng.gauss(0, 1) if n % 3 else rng.choice((1.0, 2.5, -3.0)) for _ in range(n)] for n in range(1, 301)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "n long, v double")
    got = {(r.n, r.q): r.x for r in statistics.exact_quantiles(df, ["n"], "v", QS).collect()}
    assert len(got) == 300 * len(QS)
    for (n, q), x in got.items():
        assert x == pytest.approx(np.quantile(groups[n], q), abs=1e-12), (n, q)


def test_exact_quantiles_of_large_groups_ties_and_tails(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=30_000), "tail": rng.pareto(0.3, 30_000), "fifty": rng.integers(0, 50, 30_000) * 1.0, "flat": np.full(9000, 7.0), "two": np.repeat([1.0, 2.0], 6001), "huge": np.concatenate([rng.normal(size=5000), [1e308, -1e308]])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for options in ({}, {"in_task": 3, "bins": 4}, {"in_task": 1, "bins": 16, "few": 100_000}):
        got = {(r.g, r.q): r.x for r in statistics.exact_quantiles(df, ["g"], "v", QS, **options).collect()}
        assert len(got) == len(groups) * len(QS)
        for (g, q), x in got.items():
            at = q * (len(groups[g]) - 1)
            lo, hi = (np.sort(groups[g])[int(f(at))] for f in (np.floor, np.ceil))
            assert x == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-9), (g, q)


def test_exact_quantiles_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert {(r.q, r.x) for r in statistics.exact_quantiles(df, [], "v", [0.25, 0.5]).collect()} == {(0.25, 2.5), (0.5, 5.0)}
    assert statistics.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


@pytest.mark.parametrize(("n", "want"), [(7, 29.4), (15, 159.0), (1, 1.0)])
def test_cutoff_of_few_control_events_is_their_quantile(spark, n, want):
    rows = [("g", "NC", float(i * i)) for i in range(n)] if n > 1 else [("g", "NC", 1.0)]
    df = spark.createDataFrame(rows, "gate string, role string, v double")
    assert statistics.histogram_cutoff(df, "gate", "role", "v").first().cutoff == pytest.approx(want)


def test_tube_names_take_the_last_of_keys_that_clash(spark):
    rows = [("TUBE_NAME", "a", "Tube-Name", "b"), ("tube name", " x ", "src", "y"), ("TUBE NAME", "  ", "$SRC", "s"), ("Tube_name", "a", "tube name", " ")]
    meta = F.create_map(*[F.col(c) for c in "abcd"])
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").select(meta.alias("m")).union(spark.createDataFrame([({},), (None,)], "m map<string,string>"))
    assert [r[0] for r in df.select(T.tube_name(F.col("m"), F.lit("none")).alias("t")).collect()] == ["b", "x", "s", "a", "none", "none"]


def test_positive_markers_pair_words_from_the_left(spark):
    given = {"A B- C+": None, "CD3 PerCP-A+ CD19 APC-A-": "CD3", "CD3 A- CD19 B+": "CD19", "x CD3 A+": "CD3", "A+ B+": "A+", "A": None, "": None, "  CD3\tA+ ": "CD3", "A- B C+": "B"}
    df = spark.createDataFrame([(k,) for k in [*given, None]], "l string")
    assert {r[0]: r[1] for r in df.select("l", T.positive_marker(F.col("l")).alias("m")).collect()} == given | {None: None}


# -------------------------------------------------------------------------------------------------------- signed ranks


def exact_p(d):
    """Two-sided p-value of distinct nonzero differences by all signs."""
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = np.array([sum(r for r, s in zip(ranks, format(m, f"0{len(d)}b"), strict=True) if s == "1") for m in range(2 ** len(d))])
    return min(1.0, 2 * (sums <= w).mean())


def test_signed_rank_p_values(spark):
    rng = np.random.default_rng(5)
    groups = {f"e{n}": rng.normal(0.3, 1, n) for n in (3, 4, 5, 9, 12)} | {"ties": np.array([1.0, 1, -1, 2, 3, 0, 0, 5]), "zero": np.zeros(4), "two": np.array([1.0, 2.0]), "long": rng.normal(0.2, 1, 51), "fifty": rng.normal(0.2, 1, 50)}
    df = spark.createDataFrame([(g, float(v), 0.0) for g, vs in groups.items() for v in vs] + [("e3", None, 1.0)], "g string, a double, b double")
    got = {r.g: r for r in agreement.signed_ranks(df, ["g"], "a", "b").collect()}
    for g, d in groups.items():
        assert (got[g].n_paired, got[g].n_nonzero) == (len(d), int((d != 0).sum()))
    for n in (3, 4, 5, 9, 12):
        assert got[f"e{n}"].p_value == pytest.approx(exact_p(groups[f"e{n}"]), abs=1e-12)
    assert got["zero"].p_value is None and got["two"].p_value is None
    for g in ("ties", "long"):
        d = groups[g][groups[g] != 0]
        ranks = np.array([(np.abs(d) < abs(v)).sum() + ((np.abs(d) == abs(v)).sum() + 1) / 2 for v in d])
        n, w = len(d), min(ranks[d > 0].sum(), ranks[d < 0].sum())
        counts = np.unique(np.abs(d), return_counts=True)[1]
        var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
        assert got[g].p_value == pytest.approx(min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var))), rel=1e-9)
    # the normal form is near the exact one at fifty pairs
    d = groups["fifty"]
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert got["fifty"].p_value == pytest.approx(math.erfc(abs(w - 637.5) / math.sqrt(2 * 50 * 51 * 101 / 24)), abs=0.01)


def test_upper_tail_of_the_normal_distribution(spark):
    xs = [0.0, 0.3, 1.0, 1.9, 2.0, 2.5, 2.9, 3.5, 6.0, 12.0, 30.0, -0.5, -4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", numeric.normal_sf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.x / math.sqrt(2)), rel=1e-11)
