"""Readers and writers, on files made here."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.sources import fcs, tables
from titerframe.streaming import progress


@pytest.fixture()
def fcs_folder(tmp_path):
    for i in range(2):
        x = np.array([[1.0, 20.0, 300.0], [4.0, 50.0, float("nan")], [7.0, 8e6, 9.0]], np.float32) + i
        (tmp_path / f"t{i}.fcs").write_bytes(fcs.write_fcs(x, ["FSC-A", "SSC-A", "FITC/A"], {"$P1S": "Size", "TUBE NAME": f"a/b {i}"}))
    return str(tmp_path)


def test_fcs_source(spark, fcs_folder):
    fcs.register(spark)
    ev = spark.read.format("fcs").load(fcs_folder).orderBy("file", "event_idx").collect()
    assert [(r.file, r.event_idx) for r in ev] == [("t0.fcs", 0), ("t0.fcs", 1), ("t1.fcs", 0), ("t1.fcs", 1)]  # the row with NaN is gone
    assert ev[1]["values"] == [7.0, 262144.0, 9.0] and ev[0].channels == ["FSC-A", "SSC-A", "FITC/A"]
    text = spark.read.format("fcs-text").load(fcs_folder).orderBy("file").collect()
    assert text[0].keywords["TUBE NAME"] == "a/b 0" and text[0].channels[0].pns == "Size" and text[1].n_events == 3


def test_fcs_wide(spark, fcs_folder):
    rows = fcs.read_events(spark, fcs_folder, ["SSC-A", "FSC-A"]).orderBy("file", "event_idx").collect()
    assert rows[0]["FSC-A"] == 1.0 and rows[0]["SSC-A"] == 20.0 and len(rows) == 4


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("file_name;role;sample_name\na.fcs;nc;\nb.fcs; Sample ;S1\n")
    r = {x.file_name: x for x in tables.read_metadata(spark, str(tmp_path / "m.csv")).collect()}
    assert (r["a.fcs"].role, r["a.fcs"].sample_name) == ("NC", "a") and (r["b.fcs"].role, r["b.fcs"].sample_name) == ("SAMPLE", "S1")
    with pytest.raises(ValueError):
        tables.check_metadata(spark.createDataFrame([("x",)], "file_name string"))
    with pytest.raises(Exception, match="unknown role"):
        tables.check_metadata(spark.createDataFrame([("x", "other")], "file_name string, role string")).collect()


def workbook(path, rows):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_layout(spark, tmp_path):
    rows = {1: {1: "Lot No", 3: "L77"}, 3: {1: "ID", 2: "Race", 3: "A", 4: "A", 5: "DRB"}, 4: {1: "1A", 2: "C", 3: "2", 4: "24", 5: "-"}, 5: {1: "A2", 2: "B", 3: "1", 5: "4"}, 7: {1: "A9", 3: "99"}}
    workbook(tmp_path / "l.xlsx", rows)
    grid = tables.read_grid(spark, str(tmp_path))
    got = {r.well: r for r in tables.parse_layout(grid).collect()}
    assert set(got) == {"A1", "A2"} and got["A1"].loci == {"A": ["2", "24"]} and got["A2"].loci == {"A": ["1"], "DRB1": ["4"]} and got["A1"].race == "C"
    assert [(r.field, r.value) for r in tables.layout_fields(grid, {"lot": "(?i)^lot"}).collect()] == [("lot", "L77")]
    assert tuple(tables.plate_size(tables.parse_layout(grid)).first()) == (1, 2)


def test_layout_json(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"wells": {"A1": {"well_id": "A1", "race": "C", "loci": {"data": {"A": ["1"]}}}, "A2": {"loci": {"B": ["7", "8"]}}}}))
    layout = tables.read_layout_json(spark, str(tmp_path / "l.json"))
    assert sorted((r.well, r.locus, r.allele) for r in tables.layout_rows(layout).collect()) == [("A1", "A", "1"), ("A2", "B", "7"), ("A2", "B", "8")]


def test_training_logs_and_sheets(spark, tmp_path):
    (tmp_path / "unet_3_seed7.jsonl").write_text('{"epoch": 1, "lr": 0.1, "time_sec": 2.0, "train": {"loss": 1.5}, "val": {"loss": 2.5}}\nnot json\n')
    rows = tables.read_training_logs(spark, str(tmp_path / "unet_3_seed7.jsonl")).orderBy("split").collect()
    assert [(r.split, r.metrics["loss"], r.seed, r.target, r["mode"]) for r in rows] == [("train", 1.5, 7, 3, "unet"), ("val", 2.5, 7, 3, "unet")]
    (tmp_path / "s.csv").write_text("Folder;Annotator;PRA;A1;F10\nx;me;5;1;8\ny;me;5;;2\n")
    assert tables.read_score_sheet(spark, str(tmp_path / "s.csv")).count() == 3


def test_payload_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "k string, v double")
    tables.write_payload(df, ["k"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "NaN" not in text and len(json.loads(text)["rows"]) == 2


def test_stream_state_and_upsert(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 1.0), (1, "b", "2024-01-01 01:00:00", 2.0), (2, "a", "2024-01-01 02:00:00", 5.0)], "job long, item string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src)).withWatermark("ts", "1 hour")
    q = progress.running_state(stream, "job", "value", "ts").writeStream.format("memory").queryName("state_test").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job: (r.n, r.total) for r in spark.table("state_test").where("NOT expired").collect()}
    assert got == {1: (2, 3.0), 2: (1, 5.0)}
    once = progress.first_of_each(spark.readStream.schema(df.schema).parquet(str(src)), ["item"], "ts")
    q = once.writeStream.format("memory").queryName("first_test").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_test").count() == 2
    up = progress.upsert(str(tmp_path / "t"), ["job"], "ts")
    up(df, 0)
    up(df.withColumn("value", F.lit(9.0)).withColumn("ts", F.to_timestamp(F.lit("2024-02-01"))).where("job = 1"), 1)
    assert {r.job: r.value for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {1: 9.0, 2: 5.0}


def test_fcs_ranges_read_a_file_in_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    for i, n in enumerate((1000, 7, 0)):
        x = rng.uniform(0, 1000, (n, 3)).astype(np.float32)
        x[5::50, 1] = np.nan
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / "deep" / f"f{i}.fcs").write_bytes(fcs.write_fcs(x, ["A", "B", "C"], {"$P3G": "2"}))
    wide = fcs.read_ranges(spark, str(tmp_path), ["C", "A"], rows=300)
    parts = wide.withColumn("p", F.spark_partition_id()).groupBy("file").agg(F.countDistinct("p").alias("n"), F.count("*").alias("k"))
    assert {r.file: (r.n, r.k) for r in parts.collect()} == {"f0.fcs": (4, 980), "f1.fcs": (1, 6)}
    long = spark.read.format("fcs").load(str(tmp_path)).orderBy("file", "event_idx").collect()
    rows = wide.orderBy("file", "position").collect()
    assert [(r.file, r["A"], r["C"]) for r in rows] == [(r.file, r["values"][0], r["values"][2]) for r in long]
    assert all(r.position % 50 != 5 for r in rows) and [r.event_idx for r in long if r.file == "f0.fcs"] == list(range(980))
    assert fcs.read_ranges(spark, f"file://{tmp_path}/deep/f1.fcs", ["A"]).count() == 6


def test_many_small_fcs_files_share_tasks(spark, tmp_path):
    for i in range(300):
        x = np.arange(i % 7 * 2, dtype=np.float32).reshape(-1, 2) + i
        (tmp_path / f"f{i}.fcs").write_bytes(fcs.write_fcs(x, ["A", "B"], {"$P1S": "x" * (i % 50)}))
    for df, n in ((fcs.read_ranges(spark, str(tmp_path), ["A"], rows=2), 40), (spark.read.format("fcs").load(str(tmp_path)), 10), (spark.read.format("fcs-text").load(str(tmp_path)), 10)):
        assert df.rdd.getNumPartitions() <= n
    got = fcs.read_ranges(spark, str(tmp_path), ["A"], rows=2).collect()
    assert sorted((r.file, r.position, r["A"]) for r in got) == sorted((f"f{i}.fcs", k, float(2 * k + i)) for i in range(300) for k in range(i % 7))
    got = spark.read.format("fcs").load(str(tmp_path)).collect()
    assert sorted((r.file, r.event_idx) for r in got) == sorted((f"f{i}.fcs", k) for i in range(300) for k in range(i % 7))
    assert spark.read.format("fcs-text").load(str(tmp_path)).select("file", "n_events").distinct().count() == 300


def test_fcs_channels_of_different_widths(spark, tmp_path):
    rows = [(1, 300, 70_000), (2, 65_535, 4_000_000_000)]
    data = b"".join(int(v).to_bytes(w, "big") for r in rows for v, w in zip(r, (1, 2, 4), strict=True))
    kw = {"$PAR": "3", "$TOT": "2", "$DATATYPE": "I", "$MODE": "L", "$BYTEORD": "4,3,2,1"}
    for i, w in enumerate((8, 16, 32), 1):
        kw |= {f"$P{i}N": f"c{i}", f"$P{i}B": str(w), f"$P{i}R": str(2**w), f"$P{i}E": "0,0"}

    def file(kw):
        text = "/" + "/".join(f"{k}/{v}" for k, v in kw.items()) + "/"
        start = 256 + len(text)
        return ("FCS3.1    " + "".join(f"{v:>8}" for v in (256, start - 1, start, start + len(data) - 1, 0, 0))).encode().ljust(256) + text.encode() + data

    (tmp_path / "w.fcs").write_bytes(file(kw))
    got = fcs.read_ranges(spark, str(tmp_path), ["c1", "c2", "c3"], rows=1).orderBy("position").collect()
    assert [tuple(r)[2:] for r in got] == [(1.0, 300.0, 70_000.0), (2.0, 65_535.0, 4e9)]
    for bad in ({"$P2B": "12"}, {"$DATATYPE": "F"}, {"$MODE": "H"}):
        with pytest.raises(ValueError):
            fcs.record_type(kw | bad)


def test_a_file_of_repeated_row_keys_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows = [(7, 1, float(v)) for v in range(20)]
    made = []
    for name, r in (("a", rows), ("b", rows[::-1])):
        folder = tmp_path / name
        fcs.write_files(spark.createDataFrame(r, "f int, i int, x double").coalesce(1), "f", ["i"], ["x"], str(folder)).collect()
        made.append((folder / "7.fcs").read_bytes())
    assert made[0] == made[1]


def test_the_round_trip_takes_of_tied_last_events_the_one_that_sql_meets_first(spark, tmp_path):
    import duckdb

    from titerframe.plans import trips

    c = duckdb.connect()
    c.sql("SET threads = 1")
    line = "SELECT 1 + i % 2 AS o, i // 40 AS s, ((i * 7919) % 1009) * 100.0::DOUBLE AS price FROM range(200) r(i)"
    c.sql(f"CREATE TABLE lineitem AS SELECT o AS l_orderkey, s AS l_suppkey, 1 AS l_linenumber, 5.0::DOUBLE AS l_quantity, price AS l_extendedprice, 0.1::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax FROM ({line})")
    c.sql("CREATE TABLE supplier AS SELECT CAST(i AS BIGINT) AS s_suppkey, CAST(i AS INTEGER) AS s_nationkey FROM range(5) r(i)")
    for t in ("lineitem", "supplier"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    query, sql = trips.QUERIES["src_fcs_round_trip"]
    want = {r[0]: r[1] for r in c.sql(f"SELECT file_id, last_igg FROM ({sql})").fetchall()}
    assert {r.file_id: r.last_igg for r in query(spark, str(tmp_path)).collect()} == want
