"""Assay-shaped views of the driver's tables: files and events, wells and ROIs, layouts, raters.

They give the operators inputs of the right shape; the values carry no biological meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNR, IGG_COFACTOR = 100000.0, 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("s_suppkey") % 5 == 0, "NC").when(F.col("s_suppkey") % 5 == 1, "PC").otherwise("SAMPLE")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), role.alias("role"), F.col("s_nationkey").alias("sample"))


def events(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Events of all files. ``files`` is a dimension (a row per file); the planner broadcasts it where it is small.

    ``place`` adds where an event lies in its table (``stored_in``, ``stored_at``): it tells events of equal keys apart.
    """
    li = table(spark, sf_dir, "lineitem")
    stored = {"stored_in": F.col("_metadata.file_path"), "stored_at": F.col("_metadata.row_index")} if place else {}
    li = li.withColumns(stored).join(files(spark, sf_dir), F.col("l_suppkey") == F.col("file_id"))
    lift = F.when(F.col("role") == "PC", 3.0).when(F.col("role") == "NC", 1.0).otherwise(1 + 10 * F.col("l_discount"))
    return li.select(
        "file_id", "role", "sample", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("fsc_a"), (F.col("l_extendedprice") * (1 - F.col("l_discount") / 10)).alias("fsc_h"),
        (F.col("l_quantity") * 1000).alias("ssc_a"), (F.col("l_extendedprice") / 100 * lift).alias("igg"), (F.col("l_tax") * 5000).alias("cd3"), (F.col("l_discount") * 5000).alias("cd19"),
        *stored,
    )


EVENTS = """
f AS (
  SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 5 = 0 THEN 'NC' WHEN s_suppkey % 5 = 1 THEN 'PC' ELSE 'SAMPLE' END AS role, s_nationkey AS sample FROM supplier
), ev AS (
  SELECT file_id, role, sample, l_orderkey, l_linenumber, l_extendedprice AS fsc_a, l_extendedprice * (1 - l_discount / 10) AS fsc_h, l_quantity * 1000 AS ssc_a,
         l_extendedprice / 100 * (CASE WHEN role = 'PC' THEN 3.0::DOUBLE WHEN role = 'NC' THEN 1.0::DOUBLE ELSE 1 + 10 * l_discount END) AS igg,
         l_tax * 5000 AS cd3, l_discount * 5000 AS cd19
  FROM lineitem JOIN f ON l_suppkey = file_id
), edge AS (
  SELECT *, (fsc_a > 0 AND fsc_a < 95000.0 AND ssc_a > 0 AND ssc_a < 95000.0 AND fsc_h > 0 AND fsc_h < 95000.0) AS edge, asinh(igg / 150.0) AS t FROM ev
)"""

SINGLETS = """
cut AS (SELECT file_id, quantile_cont(fsc_a, 0.02) AS c FROM edge WHERE fsc_a > 1e-12 AND fsc_h > 1e-12 GROUP BY file_id
), v AS (
  SELECT edge.*, coalesce(fsc_a > 1e-12 AND fsc_h > 1e-12 AND fsc_a >= c, false) AS valid, ln(1 + greatest(fsc_h, 0)) - ln(1 + greatest(fsc_a, 0)) AS r
  FROM edge LEFT JOIN cut USING (file_id)
), m AS (SELECT file_id, median(r) AS med, count(*) AS n FROM v WHERE valid GROUP BY file_id
), d AS (SELECT v.file_id, median(abs(r - med)) AS mad FROM v JOIN m USING (file_id) WHERE valid GROUP BY v.file_id
), sing AS (
  SELECT v.*, valid AND (n < 300 OR mad <= 0 OR (r >= med - 4 * mad AND r <= med + 4 * mad)) AS singlet
  FROM v LEFT JOIN m USING (file_id) LEFT JOIN d USING (file_id)
)"""


def wells(k, letters: int = 10):
    """Well of a key: A1..F10 by 60 values."""
    return F.concat(F.char(F.lit(65) + F.floor(k / letters)), (k % letters + 1).cast("string"))


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 60
    well = wells(k)
    role = F.when(well.isin("A1", "B1"), "negative").when(well.isin("A10", "B10"), "positive").otherwise("sample")
    green = (50 + F.col("o_orderkey") % 50) * F.when(role == "positive", 0.2).otherwise(1.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("plate"), well.alias("well"), role.alias("role"), F.col("o_orderkey").alias("roi_id"), (F.col("o_totalprice") / 1000).alias("mean_r"), green.alias("mean_g"),
        (F.col("o_orderkey") % 400 + 20).alias("area"), F.col("o_orderdate").alias("seen_at"),
    )


ROIS = """
ro0 AS (
  SELECT o_orderpriority AS plate, chr(CAST(65 + (o_custkey % 60) // 10 AS INTEGER)) || CAST((o_custkey % 60) % 10 + 1 AS VARCHAR) AS well, o_orderkey AS roi_id, o_totalprice / 1000 AS mean_r,
         o_orderkey % 50 + 50 AS g, o_orderkey % 400 + 20 AS area, o_orderdate AS seen_at
  FROM orders
), ro AS (
  SELECT *, g * (CASE WHEN well IN ('A10', 'B10') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) AS mean_g,
         CASE WHEN well IN ('A1', 'B1') THEN 'negative' WHEN well IN ('A10', 'B10') THEN 'positive' ELSE 'sample' END AS role
  FROM ro0
)"""


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of wells: well, locus, allele (distinct)."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(wells(F.col("c_custkey") % 60).alias("well"), F.col("c_mktsegment").alias("locus"), F.col("n_name").alias("allele")).distinct()


LAYOUT = """
lay AS (
  SELECT DISTINCT chr(CAST(65 + (c_custkey % 60) // 10 AS INTEGER)) || CAST((c_custkey % 60) % 10 + 1 AS VARCHAR) AS well, c_mktsegment AS locus, n_name AS allele
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
