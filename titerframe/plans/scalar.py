"""Scalar functions on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .proxies import table


def channel_roles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = F.element_at(F.array(*[F.lit(x) for x in ("FSC-A", "SSC_H", "Time", "FITC IgG", "Iso-1", "CD3 PerCP", "CD19")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", label.alias("label"), T.channel_role(label).alias("role"), T.population_of(label).alias("population"), T.scatter_channel(label).alias("channel"), T.safe_name(label).alias("name"))


_LABEL = "(['FSC-A', 'SSC_H', 'Time', 'FITC IgG', 'Iso-1', 'CD3 PerCP', 'CD19'])[p_partkey % 7 + 1]"


def well_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a 0"), (F.col("c_custkey") % 9 + 1).cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat((F.col("c_custkey") % 12 + 1).cast("string"), F.lit("b"))).otherwise(F.lit("x"))
    return c.select("c_custkey", T.well_id(raw).alias("well"), N.well_column(T.well_id(raw)).alias("col"))


def urls(spark, sf_dir):
    u = table(spark, sf_dir, "pages")
    return u.select("page_id", T.base_name(F.col("url")).alias("base"), T.inside(F.col("url")).alias("inside"))


def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Img_"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("name"))
    # one row a file of a small dimension table
    return s.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(T.natural_key(F.col("name"))))).withColumn("anonymous", F.format_string("%06d", "place"))


def scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = (F.col("o_totalprice") % 1000) / 10.0
    ref = (F.col("o_orderkey") % 30).cast("double")
    corrected = N.corrected_fraction(p, ref, ref + 40.0)
    return o.select("o_orderkey", N.cdc_score(p).alias("score"), F.round(corrected, 6).alias("corrected"), N.call(corrected, 20.0).alias("call"), N.borderline(corrected).alias("borderline"), F.round(N.fluorescence_index(p, ref, F.lit(80.0)), 6).alias("fi"))


def densities(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    x, y = F.col("o_totalprice") / 100000 - 2, (F.col("o_orderkey") % 7) / 7.0
    lit = lambda v: F.lit(float(v))
    return o.select("o_orderkey", F.round(N.normal_cdf(x), 5).alias("cdf"), F.round(N.gaussian2_logpdf(x, y, lit(0), lit(0.5), lit(1), lit(0.2), lit(0.1)), 6).alias("logpdf"), F.round(N.oks(F.abs(x), 3.0), 6).alias("oks"))


def json_meta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), k, F.lit(-1)).alias("first_present"))


def params(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    m = F.create_map(F.lit("k"), F.col("s_suppkey").cast("string"), F.lit("a"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", T.params_json(m).alias("params"))


def hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha"), F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("name"))


def channels_of_images(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("plate_"), F.col("s_suppkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("_red.tif", "_G.png", "_b.jpg", "_rg.tif")]), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return s.select("s_suppkey", name.alias("name"), T.rgb_channel(name).alias("channel"), T.stem(name).alias("stem"))


def loci(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    h = F.element_at(F.array(*[F.lit(x) for x in (' "A" ', "DRB", "B*27:05", "Cw", "DQB:", " ")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select("s_suppkey", T.locus(h).alias("locus"))


QUERIES = {
    "str_channel_roles": (channel_roles, f"""SELECT p_partkey, {_LABEL} AS label, CASE {_LABEL} WHEN 'FSC-A' THEN 'scatter' WHEN 'SSC_H' THEN 'scatter' WHEN 'Time' THEN 'time' WHEN 'FITC IgG' THEN 'igg' WHEN 'Iso-1' THEN 'igg' ELSE 'marker' END AS role,
  CASE {_LABEL} WHEN 'CD3 PerCP' THEN 'T cells' WHEN 'CD19' THEN 'B cells' ELSE 'Unknown' END AS population, upper(replace({_LABEL}, '_', '-')) AS channel, regexp_replace({_LABEL}, '[ /-]', '_', 'g') AS name FROM part"""),
    "str_well_ids": (well_ids, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A' || CAST(c_custkey % 9 + 1 AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'B' || CAST(c_custkey % 12 + 1 AS VARCHAR) END AS well, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 + 1 WHEN c_custkey % 3 = 1 THEN c_custkey % 12 + 1 END AS INTEGER) AS col FROM customer"),
    "str_paths": (urls, r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base, NOT (url LIKE '/%' OR regexp_matches(url, '(^|/)\.\.(/|$)') OR regexp_matches(url, '^[A-Za-z]:')) AS inside FROM pages"),
    "srt_natural_order": (natural_order, "SELECT s_suppkey, 'Img_' || CAST(s_suppkey AS VARCHAR) || '.tif' AS name, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS place, lpad(CAST(row_number() OVER (ORDER BY s_suppkey) AS VARCHAR), 6, '0') AS anonymous FROM supplier"),
    "prj_scores": (scores, """WITH p AS (SELECT o_orderkey, (o_totalprice % 1000) / 10.0::DOUBLE AS p, CAST(o_orderkey % 30 AS DOUBLE) AS r FROM orders), c AS (SELECT *, greatest(0.0, least(100.0, (p - r) / (r + 40.0::DOUBLE - r) * 100.0::DOUBLE)) AS c FROM p)
SELECT o_orderkey, CASE WHEN p <= 10 THEN 1 WHEN p <= 20 THEN 2 WHEN p <= 50 THEN 4 WHEN p <= 80 THEN 6 ELSE 8 END AS score, round(c, 6) AS corrected, CASE WHEN c >= 20 THEN 'positive' ELSE 'negative' END AS call, c BETWEEN 15 AND 25 AS borderline, round((p - r) / (80.0::DOUBLE - r) * 100.0::DOUBLE, 6) AS fi FROM c"""),
    "mth_densities": (densities, """WITH x AS (SELECT o_orderkey, o_totalprice / 100000 - 2 AS x, (o_orderkey % 7) / 7.0::DOUBLE AS y FROM orders), e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x) / sqrt(2)) AS t, abs(x) / sqrt(2) AS z FROM x)
SELECT o_orderkey, round(0.5 * (1 + sign(x) * (1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z))), 5) AS cdf,
  round(-0.5 * ((0.2::DOUBLE * x * x - 0.2::DOUBLE * x * (y - 0.5) + (y - 0.5) * (y - 0.5)) / 0.19::DOUBLE + ln(0.19::DOUBLE) + 2 * ln(2 * pi())), 6) AS logpdf, round(exp(-(x * x) / (2 * 0.3::DOUBLE * 0.3::DOUBLE)), 6) AS oks FROM e"""),
    "jsn_meta": (json_meta, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS first_present FROM events"),
    "str_params_json": (params, """SELECT s_suppkey, '{"a":"' || CAST(s_nationkey AS VARCHAR) || '","k":"' || CAST(s_suppkey AS VARCHAR) || '"}' AS params FROM supplier"""),
    "hsh_sha256": (hashes, "SELECT doc_id, sha256(text) AS sha, 'doc' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS name FROM documents"),
    "str_image_channels": (channels_of_images, "SELECT s_suppkey, 'plate_' || CAST(s_suppkey AS VARCHAR) || (['_red.tif', '_G.png', '_b.jpg', '_rg.tif'])[s_suppkey % 4 + 1] AS name, (['red', 'green', 'blue', NULL])[s_suppkey % 4 + 1] AS channel, 'plate_' || CAST(s_suppkey AS VARCHAR) || (['_red', '_G', '_b', '_rg'])[s_suppkey % 4 + 1] AS stem FROM supplier"),
    "str_loci": (loci, "SELECT s_suppkey, (['A', 'DRB1', 'B', 'C', 'DQB1', NULL])[s_suppkey % 6 + 1] AS locus FROM supplier"),
}
