"""Queries of value maps, lookups and calibration steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import mapping as M
from .proxies import ROIS, rois, table

KNOTS = [(0.0, 0.0), (100000.0, 10.0), (200000.0, 40.0), (400000.0, 100.0)]


def piecewise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(M.piecewise_linear(F.col("o_totalprice"), KNOTS), 6).alias("y"))


def knots(spark, sf_dir):
    k = M.quantile_knots(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.0, 0.25, 0.5, 0.75, 1.0])
    return k.withColumn("x", F.round("x", 6))


def matched(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = [0.0, 0.5, 1.0]
    source = M.quantile_knots(o, ["o_orderstatus"], "o_totalprice", q)
    target = source.withColumn("x", F.col("q") * 100.0)
    m = M.quantile_match(o, ["o_orderstatus"], "o_totalprice", source, target)
    return m.select("o_orderkey", F.round("mapped", 6).alias("mapped"))


def bits(spark, sf_dir):
    return M.bit_depth(table(spark, sf_dir, "part").withColumn("v", F.col("p_size") * 4), ["p_brand"], "v")


def stretch(spark, sf_dir):
    s = M.stretched(rois(spark, sf_dir), ["plate"], "mean_r")
    return s.groupBy("plate").agg(F.round(F.avg("stretched"), 6).alias("mean"), F.round(F.min("stretched"), 6).alias("lo"), F.round(F.max("stretched"), 6).alias("hi"))


def gap(spark, sf_dir):
    g = M.feature_gap(table(spark, sf_dir, "documents"), "lang", "en", "de", "n_chars")
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


def names(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("run"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/f"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".fcs")).alias("path"))
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".fcs")).alias("name")).union(known.where("path LIKE 'run0%'").select("path").distinct())
    return M.resolve_names(wanted, known, "name", "path")


def unlabelled(spark, sf_dir):
    modes = spark.createDataFrame([(1, "T"), (2, "T"), (4, "B"), (10, "empty")], "col int, mode string")
    return M.unlabelled_columns(rois(spark, sf_dir).select("well"), modes)


def linked(spark, sf_dir):
    """Every order is linked to its customer's order before it: chains as long as a customer has orders."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(F.md5(F.col("o_orderkey").cast("string"))))
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.coalesce(before, "o_orderkey").alias("b"))
    return graphs.components(e, "a", "b")


def scaled(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(M.unit_scaled(F.col("p_size") * 10.0, "uint8"), 6).alias("u8"), F.round(M.unit_scaled(F.col("p_retailprice"), "float", F.lit(2000.0)), 6).alias("f"))


_PIECE = "CASE WHEN o_totalprice <= 0 THEN 0.0 WHEN o_totalprice < 100000 THEN o_totalprice * (10.0::DOUBLE / 100000) WHEN o_totalprice < 200000 THEN 10 + (o_totalprice - 100000) * (30.0::DOUBLE / 100000) WHEN o_totalprice < 400000 THEN 40 + (o_totalprice - 200000) * (60.0::DOUBLE / 200000) ELSE 100.0 END"
_NAMES = """WITH k AS (SELECT 'run' || CAST(s_suppkey % 3 AS VARCHAR) || '/f' || CAST(s_suppkey % 40 AS VARCHAR) || '.fcs' AS path FROM supplier),
w AS (SELECT 'f' || CAST(s_suppkey AS VARCHAR) || '.fcs' AS name FROM supplier UNION ALL SELECT DISTINCT path FROM k WHERE path LIKE 'run0%'),
b AS (SELECT regexp_extract(path, '[^/]*$') AS base, count(DISTINCT path) AS n, min(path) AS single FROM k GROUP BY 1)
SELECT name, coalesce(e.path, CASE WHEN n = 1 THEN single END) AS resolved, e.path IS NULL AND coalesce(n > 1, false) AS ambiguous FROM w LEFT JOIN (SELECT DISTINCT path FROM k) e ON e.path = name LEFT JOIN b ON base = regexp_extract(name, '[^/]*$')"""
QUERIES = {
    "map_piecewise": (piecewise, f"SELECT o_orderkey, round({_PIECE}, 6) AS y FROM orders"),
    "map_quantile_knots": (knots, " UNION ALL ".join(f"SELECT o_orderpriority, {q}::DOUBLE AS q, round(quantile_cont(o_totalprice, {q}), 6) AS x FROM orders GROUP BY 1" for q in (0.0, 0.25, 0.5, 0.75, 1.0))),
    "map_quantile_match": (matched, "WITH k AS (SELECT o_orderstatus, min(o_totalprice) AS a, median(o_totalprice) AS m, max(o_totalprice) AS b FROM orders GROUP BY 1) SELECT o_orderkey, round(CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice >= b THEN 100 WHEN o_totalprice < m THEN (o_totalprice - a) / (m - a) * 50 ELSE 50 + (o_totalprice - m) / (b - m) * 50 END, 6) AS mapped FROM orders JOIN k USING (o_orderstatus)"),
    "map_bit_depth": (bits, "WITH g AS (SELECT p_brand, bit_or(CAST(p_size * 4 AS BIGINT)) AS o, max(CAST(p_size * 4 AS BIGINT)) AS most FROM part GROUP BY 1) SELECT p_brand, most, CASE WHEN o > 0 THEN length(bin(o)) ELSE 0 END::INTEGER AS bits, CASE WHEN o > 0 THEN length(bin(o)) - length(rtrim(bin(o), '0')) ELSE 0 END::INTEGER AS shift FROM g"),
    "map_stretch": (stretch, f"WITH {ROIS}, q AS (SELECT plate, quantile_cont(mean_r, 0.005) AS lo, quantile_cont(mean_r, 0.995) AS hi FROM ro GROUP BY plate), s AS (SELECT ro.plate, greatest(0.0, least(1.0, (mean_r - lo) / (hi - lo))) AS s FROM ro JOIN q USING (plate)) SELECT plate, round(avg(s), 6) AS mean, round(min(s), 6) AS lo, round(max(s), 6) AS hi FROM s GROUP BY plate"),
    "agg_feature_gap": (gap, "WITH g AS (SELECT median(n_chars) FILTER (lang = 'en') AS mr, median(n_chars) FILTER (lang = 'de') AS ms, stddev_samp(n_chars) FILTER (lang = 'en') AS sr, quantile_cont(n_chars, 0.1) FILTER (lang = 'en') AS lr, quantile_cont(n_chars, 0.9) FILTER (lang = 'en') AS hr, quantile_cont(n_chars, 0.1) FILTER (lang = 'de') AS ls, quantile_cont(n_chars, 0.9) FILTER (lang = 'de') AS hs FROM documents) SELECT round((ms - mr) / sr, 6) AS z, round(ms / mr, 6) AS ratio, round(greatest(least(hr, hs) - greatest(lr, ls), 0) / (greatest(hr, hs) - least(lr, ls)), 6) AS overlap FROM g"),
    "uio_resolve_names": (names, _NAMES),
    "uio_unlabelled_columns": (unlabelled, f"WITH {ROIS} SELECT DISTINCT CAST(substr(well, 2) AS INTEGER) AS col FROM ro WHERE CAST(substr(well, 2) AS INTEGER) NOT IN (1, 2, 4)"),
    "val_components": (linked, "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders"),
    "map_unit_scaled": (scaled, "SELECT p_partkey, round(greatest(0.0, least(1.0, p_size * 10.0::DOUBLE / 255)), 6) AS u8, round(greatest(0.0, least(1.0, p_retailprice / 2000)), 6) AS f FROM part"),
}
