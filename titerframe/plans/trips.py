"""Round trips through readers, writers and stores, merged state, and the full view of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, readouts, reports
from ..operators.staging import remove_folder, scratch_root, staged
from ..sources import fcs, tables
from ..sources.store import DocumentStore, VersionedTable
from ..streaming import state
from .flow import KEY, METRICS, _gated
from .proxies import EVENTS, events, files, table

CHANNELS = ["fsc_a", "ssc_a", "igg", "cd3"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fcs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as an FCS file per file, and read back by ranges of 400 events.

    Of events with equal keys the first in the table comes last in its file, as ``arg_max`` keeps the first that it meets.
    """
    folder = _folder(spark, "fcs")
    written = fcs.write_files(events(spark, sf_dir, place=True), "file_id", [*KEY, F.desc("stored_in"), F.desc("stored_at")], CHANNELS, folder)
    wrote = staged(written, "written")
    read = fcs.read_ranges(spark, folder, CHANNELS, rows=400)
    by_file = read.groupBy("file").agg(F.count("*").alias("n"), (F.max("position") + 1).alias("n_events"), *[F.round(F.avg(c), 2).alias(c) for c in CHANNELS], F.round(F.max_by("igg", "position"), 2).alias("last_igg"))
    by_file = by_file.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("file_id"), *by_file.columns[1:])
    out = staged(by_file.join(wrote.select(F.col("file").alias("file_id"), F.col("n").alias("n_written")), "file_id"), "read-back")
    remove_folder(spark, folder)
    return out


def metadata_round_trip(spark, sf_dir):
    """The table of files written as delimited text and read with its roles checked and samples filled in."""
    folder = _folder(spark, "metadata")
    f = files(spark, sf_dir)
    name = F.concat(F.lit("run/f"), F.col("file_id").cast("string"), F.lit(".fcs"))
    out = f.select(name.alias("File_Name"), F.when(F.col("file_id") % 2 == 0, F.lower("role")).otherwise(F.concat(F.lit(" "), F.col("role"))).alias("Role"), F.when(F.col("file_id") % 3 != 0, F.concat(F.lit("S"), F.col("sample").cast("string"))).alias("sample_name"))
    tables.write_csv(out, folder)
    read = staged(tables.read_metadata(spark, folder), "metadata")
    remove_folder(spark, folder)
    return read


def resumed_runs(spark, sf_dir):
    """Orders kept by customer through three runs of a versioned table, the second of them repeated."""
    folder = _folder(spark, "store")
    store = VersionedTable(spark, folder)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for part, run in ((0, "a"), (1, "b"), (1, "b"), (2, "c")):
        store.upsert(o.where(F.col("o_orderkey") % 3 == part), ["o_custkey"], "o_orderkey", run)
    out = staged(store.read().withColumn("version", F.lit(store.state()["version"])), "kept")
    remove_folder(spark, folder)
    return out


def appended_once(spark, sf_dir):
    """Customers of orders, in two runs whose keys overlap: each key once."""
    folder = _folder(spark, "store")
    store = VersionedTable(spark, folder)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").distinct()
    store.append_missing(o.where("o_orderstatus <> 'O'"), ["o_custkey", "o_orderstatus"], "first")
    store.append_missing(o, ["o_custkey", "o_orderstatus"], "second")
    out = staged(store.read(), "kept")
    remove_folder(spark, folder)
    return out


def documents_by_hash(spark, sf_dir):
    """Documents of equal content saved under several ids, in two runs, and found by the hash of their content."""
    folder = _folder(spark, "documents")
    store = DocumentStore(spark, folder)
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("body"))
    store.save(d, "first")
    store.save(d, "second")
    found = store.by_sha(d.select(F.sha2(F.col("body").cast("binary"), 256).alias("sha256")))
    out = staged(found.select("id", "sha256", F.col("body").cast("string").alias("body")), "found")
    remove_folder(spark, folder)
    return out


def payload_round_trip(spark, sf_dir):
    """Orders nested under their customers as JSON lines, read back: what was not a number is missing."""
    folder = _folder(spark, "payload")
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    tables.write_payload(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", price.alias("price")), ["o_custkey"], folder)
    read = spark.read.json(folder, schema="o_custkey long, rows array<struct<o_orderkey:long,price:double>>")
    out = staged(read.select("o_custkey", F.inline("rows")), "payload")
    remove_folder(spark, folder)
    return out


def merged(spark, sf_dir):
    """Per user the last event of every type, as one merged state."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("event_id").cast("string"))
    out = state.merged_table(e, "user_id", "event_type", "v", "ts")
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return out.select("job", "n_updates", "updated_ms", F.array_join(pairs, ";").alias("fields"))


def full_view(spark, sf_dir):
    """The page of every file for one gate: counts of points and lines, sums over them, metrics and cutoff."""
    ev = staged(_gated(spark, sf_dir).select("file_id", "role", *KEY, "fsc_a", "ssc_a", "igg", "t", "edge"), "gated")
    gate = {"All Cells": F.col("edge")}
    controls = readouts.control_stats(gates.explode_gates(ev, gate), "gate", "role", "igg", "t")
    metrics = readouts.readouts_of_gates(ev, ["file_id"], gate, "igg", "t", controls)
    v = reports.full_views(ev, metrics, controls, "file_id", "role", KEY, "fsc_a", "ssc_a", "t", "All Cells", F.col("edge"), 40, 64)
    xs = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"]), 4)
    line = lambda i: F.round(F.aggregate(F.zip_with(F.get("lines", F.lit(i))["x"], F.get("lines", F.lit(i))["density"], lambda x, d: x * d), F.lit(0.0), lambda a, b: a + b), 6)
    rounded = [F.round(c, 6).alias(c) for c in METRICS]
    series = F.array_join(F.transform("lines", lambda s: s["series"]), ",")
    return v.select(
        "file_id", "gate", "n_events", *rounded, F.round("cutoff", 6).alias("cutoff"), F.size("points").alias("n_points"), xs("points").alias("sum_x"), F.size("nc_points").alias("n_nc"), xs("nc_points").alias("nc_x"),
        F.size("pc_points").alias("n_pc"), xs("pc_points").alias("pc_x"), series.alias("series"), line(0).alias("mean_file"), line(1).alias("mean_nc"), line(2).alias("mean_pc"),
    )


def _view_sql() -> str:
    from .flow import _CUTOFF, _READ

    drawn = "md5('0|' || {0}CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"
    own, pooled = drawn.format(""), drawn.format("CAST(file_id AS VARCHAR) || '|' || ")
    return f"""WITH {EVENTS}, lg AS (SELECT *, 'All Cells' AS gate FROM edge WHERE edge), {_CUTOFF},
pts AS (SELECT file_id, fsc_a FROM edge QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {own}, l_orderkey, l_linenumber) <= 40),
pf AS (SELECT file_id, CAST(count(*) AS INTEGER) AS n_points, round(sum(fsc_a), 4) AS sum_x FROM pts GROUP BY 1),
cp AS (SELECT role, fsc_a FROM edge WHERE role IN ('NC', 'PC') QUALIFY row_number() OVER (PARTITION BY role ORDER BY {pooled}, file_id, l_orderkey, l_linenumber) <= 40),
cs AS (SELECT CAST(count(*) FILTER (role = 'NC') AS INTEGER) AS n_nc, round(sum(fsc_a) FILTER (role = 'NC'), 4) AS nc_x, CAST(count(*) FILTER (role = 'PC') AS INTEGER) AS n_pc, round(sum(fsc_a) FILTER (role = 'PC'), 4) AS pc_x FROM cp),
lim AS (SELECT quantile_cont(t, 0.001) AS lo, quantile_cont(t, 0.999) AS hi, (quantile_cont(t, 0.999) - quantile_cont(t, 0.001)) / 64 AS w FROM lg),
bn AS (SELECT file_id, role, lim.lo + (least(floor((t - lim.lo) / lim.w), 63) + 0.5) * lim.w AS x FROM lg, lim WHERE t >= lim.lo AND t <= lim.hi),
lf AS (SELECT file_id, round(avg(x), 6) AS mean_file FROM bn GROUP BY 1),
lc AS (SELECT round(avg(x) FILTER (role = 'NC'), 6) AS mean_nc, round(avg(x) FILTER (role = 'PC'), 6) AS mean_pc FROM bn),
rd AS (SELECT file_id, lg.gate AS gate, {_READ}, round(first(cutoff), 6) AS cutoff FROM lg JOIN cu USING (gate) JOIN ct USING (gate) GROUP BY file_id, lg.gate)
SELECT rd.*, n_points, sum_x, n_nc, nc_x, n_pc, pc_x, 'file,NC,PC' AS series, mean_file, mean_nc, mean_pc FROM rd JOIN pf USING (file_id) JOIN lf USING (file_id), cs, lc"""


_REAL = ", ".join(f"round(avg(CAST(CAST({c} AS REAL) AS DOUBLE)), 2) AS {c}" for c in CHANNELS)
QUERIES = {
    "src_fcs_round_trip": (fcs_round_trip, f"WITH {EVENTS} SELECT file_id, count(*) AS n, count(*) AS n_events, {_REAL}, round(CAST(arg_max(CAST(igg AS REAL), (l_orderkey, l_linenumber)) AS DOUBLE), 2) AS last_igg, count(*) AS n_written FROM ev GROUP BY file_id"),
    "src_metadata_round_trip": (metadata_round_trip, "SELECT 'run/f' || s_suppkey || '.fcs' AS file_name, CASE WHEN s_suppkey % 5 = 0 THEN 'NC' WHEN s_suppkey % 5 = 1 THEN 'PC' ELSE 'SAMPLE' END AS role, CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_nationkey ELSE 'f' || s_suppkey END AS sample_name FROM supplier"),
    "src_resumed_runs": (resumed_runs, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, CAST(3 AS INTEGER) AS version FROM orders GROUP BY o_custkey"),
    "src_appended_once": (appended_once, "SELECT DISTINCT o_custkey, o_orderstatus FROM orders"),
    "src_documents_by_hash": (documents_by_hash, "SELECT min(n_name) AS id, sha256(r_name) AS sha256, r_name AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "snk_payload_round_trip": (payload_round_trip, "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders"),
    "st_merged_state": (merged, "WITH l AS (SELECT user_id, event_type, arg_max(CAST(event_id AS VARCHAR), (epoch_us(ts) // 1000, CAST(event_id AS VARCHAR))) AS v, count(*) AS n, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT user_id AS job, CAST(sum(n) AS BIGINT) AS n_updates, max(last_ms) AS updated_ms, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS fields FROM l GROUP BY user_id"),
    "rpt_full_view": (full_view, _view_sql()),
}
