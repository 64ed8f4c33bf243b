"""Report views, checks and sources on odd inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from titerframe.functions import text as T
from titerframe.operators import graphs, reports, statistics
from titerframe.sources import tables


def test_exact_quantiles_of_ties_nulls_and_small_groups(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(4000)], "b": [5.0], "c": [rng.choice((1.0, 2.0)) for _ in range(900)], "d": [rng.expovariate(0.001) for _ in range(777)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None), (None, 1.0)]
    got = {(r.g, r.q): r.x for r in statistics.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.001, 0.5, 0.9, 1.0]).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for q in (0.0, 0.001, 0.5, 0.9, 1.0):
            at = q * (len(vs) - 1)
            lo = int(at)
            assert got.pop((g, q)) == pytest.approx(vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (at - lo))
    assert not got


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in up}


def test_subset_invariant(spark):
    df = spark.createDataFrame([(True, True), (None, False), (False, True)], "i boolean, o boolean")
    assert reports.assert_subset(df, F.col("i"), F.col("o"), "outside").count() == 3
    with pytest.raises(PySparkException):
        reports.assert_subset(spark.createDataFrame([(True, None)], df.schema), F.col("i"), F.col("o"), "outside").collect()


def test_names_and_labels(spark):
    assert reports.ground_truth_column(["root/lymphocytes/CD3+", "x"], "root/singlets/lymphocytes/CD3+") == "root/lymphocytes/CD3+"
    assert reports.ground_truth_column(["all/lymphocytes/B", "x"], "root/lymphocytes/B") == "all/lymphocytes/B"
    with pytest.raises(KeyError):
        reports.ground_truth_column(["a/lymphocytes/B", "b/lymphocytes/B"], "root/lymphocytes/B")
    df = spark.createDataFrame([("CD3 PerCP-A+ CD19 APC-A-",), ("CD3 A- CD19 B+",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(T.positive_marker(F.col("l"))).collect()] == ["CD3", "CD19", None, None]


def test_circles_and_exclusions(spark):
    rows = [("i", 1, "x", "3", "1", "1", "4"), ("i", 2, "3", "3", "5", "5", "4"), ("i", 3, "3", "3", "5", "5", "4"), ("i", 4, "-9", "3", "1", "1", "4")]
    c = spark.createDataFrame(rows, "image string, id int, roi_x_px string, roi_y_px string, center_x_px string, center_y_px string, diameter_px string")
    assert sorted(r.id for r in reports.clean_circles(c, ["image"], "id", 40, 40).collect()) == [1, 2]
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "a")], "k int, s string")
    assert [(r.k, r.s) for r in reports.without(df, df.where("k = 1"), ["k", "s"]).collect()] == [(2, "a")]


def test_validation_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n5,6\n")
    assert sorted(map(tuple, tables.read_csv_set(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()), key=str) == [("1", "2", None), (None, "5", "6")]
    (tmp_path / "t.csv").write_text("source_key,tile\ni,1\ni,2\nj,1\n")
    assert sorted(map(tuple, tables.read_tile_manifest(spark, str(tmp_path / "t.csv")).collect())) == [("i", 2), ("j", 1)]
    (tmp_path / "t.csv").write_text("source_key,tile\ni,1\ni,1\n")
    with pytest.raises(PySparkException):
        tables.read_tile_manifest(spark, str(tmp_path / "t.csv")).collect()
    (tmp_path / "g.csv").write_text("file,root/a,root/a/b\nf1,0.5,x\n")
    roles = spark.createDataFrame([("f1", "NC"), ("f1", "NC")], "file string, role string")
    got = tables.read_gate_truth(spark, str(tmp_path / "g.csv"), roles).collect()
    assert sorted((r.role, r.gate, r.value) for r in got) == [("NC", "root/a", 0.5), ("NC", "root/a/b", None)]
    for n in ("c1", "c2"):
        (tmp_path / "circles").mkdir(exist_ok=True)
        (tmp_path / "circles" / f"{n}.csv").write_text(",".join(tables.CIRCLE_COLUMNS) + f"\nim,{n},1,1,2,2,2\n")
    assert sorted(r.annotator for r in tables.read_circles(spark, str(tmp_path / "circles")).collect()) == ["c1", "c2"]
    (tmp_path / "circles" / "c3.csv").write_text((tmp_path / "circles" / "c1.csv").read_text())
    with pytest.raises(PySparkException):
        tables.read_circles(spark, str(tmp_path / "circles")).collect()
    (tmp_path / "j.json").write_text(json.dumps({"id": "x", "n": 2}, indent=1))
    (d,) = tables.read_documents(spark, str(tmp_path / "j.json"), "id string, n int").collect()
    assert (d.id, d.n, d.file) == ("x", 2, "j.json")
    body = tables.as_json(spark.createDataFrame([(1, None)], "k int, v string"), ["k"]).first().body
    assert json.loads(body) == {"k": 1, "v": None}


def test_points_of_repeated_row_keys_do_not_depend_on_the_order_of_arrival(spark):
    rows = [(1, 5, float(v), float(-v), v % 2 == 0) for v in range(40)]
    take = lambda r: reports.plot_points(spark.createDataFrame(r, "f int, i int, x double, y double, g boolean").coalesce(1), ["f"], ["i"], "x", "y", F.col("g"), 10).first().points
    assert take(rows) == take(rows[::-1]) and [p.x for p in take(rows)] == [float(v) for v in range(10)]
