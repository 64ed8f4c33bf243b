"""Queries of tiles joined to images, centres against heat maps, loaders, and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparisons as C
from ..operators.spatial import pixel_scores
from .pixels import IMG, _pixels, _px
from .proxies import table
from .scores import _r, _ratings


def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping tiles of every image, annotated differently."""
    j = _pixels(spark, sf_dir).select("image", "y", "x", F.col("label").alias("a")).join(_pixels(spark, sf_dir, 3).select("image", "y", "x", F.col("label").alias("b")), ["image", "y", "x"])
    one = F.struct(F.lit(0).alias("o"), (F.col("a") > 0).alias("truth"), (F.col("b") > 0).alias("predicted"))
    two = F.struct(F.lit(8).alias("o"), (F.col("a") % 3 == 1).alias("truth"), (F.col("b") % 2 == 1).alias("predicted"))
    t = j.select("image", "y", "x", F.explode(F.array(one, two)).alias("t")).select("image", F.col("t.o").alias("y0"), F.col("t.o").alias("x0"), (F.col("y") - F.col("t.o")).alias("ty"), (F.col("x") - F.col("t.o")).alias("tx"), "t.truth", "t.predicted")
    return _r(C.tile_union(t.where("ty BETWEEN 0 AND 31 AND tx BETWEEN 0 AND 31"), IMG, height=40, width=40), "dice", "jaccard", "coverage")


def mask_totals(spark, sf_dir):
    """Quarters of every image as tiles, summed up by image."""
    quarter = (F.floor(F.col("y") / 20) * 2 + F.floor(F.col("x") / 20)).alias("tile")
    a, b = (_pixels(spark, sf_dir, s).select("*", quarter) for s in (0, 3))
    tiles = pixel_scores(a, b, ["image", "tile"]).withColumn("tn", 400 - F.col("tp") - F.col("fp") - F.col("fn"))
    return _r(C.mask_totals(tiles, IMG), "precision", "recall", "f1", "accuracy", "dice", "jaccard")


def prediction_rows(spark, sf_dir):
    return _r(C.prediction_rows(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), _pixels(spark, sf_dir), IMG, "r", 35.0, 3), "dice", "jaccard")


def centre_metrics(spark, sf_dir):
    heat = _pixels(spark, sf_dir).withColumn("v", F.col("r") / 50)
    out = C.centre_metrics(heat, _pixels(spark, sf_dir), IMG, "v", threshold=0.6, distance=3, radius=6.0, thresholds=(0.5, 0.6, 0.7, 0.8))
    return _r(out, *[c for c, kind in out.dtypes if kind == "double"])


def loaded(spark, sf_dir):
    """Validation rows without repeats, with their count error in percent."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 300).alias("idx"), F.col("lang").alias("dataset_mode"), (F.col("n_chars") % 50).alias("n_cells_gt_instances"), ((F.col("n_chars") % 7) - 3).alias("count_error_instances"),
    )
    once = C.first_of_keys(d, ["idx", "tile_idx", "dataset_mode"], ["doc_id"])
    out = C.count_error_percent(once, ["count_error_components", "count_error_instances"], ["n_cells_per_img", "n_cells_gt_instances"])
    return C.annotator_rows(_r(out, "count_error_pct"), "imageJ", {"dataset_mode": "mode"}, ["idx", "mode"]).select("doc_id", "idx", "mode", "annotator", "count_error_pct", "count_error_pct_source", "count_error_pct_denominator")


def evaluated(spark, sf_dir):
    """Scores that raters are judged by: people's own, methods' adjusted or else their own."""
    adjusted = F.when(F.col("well_key") % 3 != 0, F.col("score") + 1)
    s = _ratings(spark, sf_dir).withColumn("evaluation", C.evaluation_score(F.col("annotator"), F.col("score"), adjusted, ["1", "2"]))
    return s.select("folder", "well_key", "annotator", "evaluation")


def checkpoints(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("models/unet_"), F.when(k % 2 == 0, "tiles").otherwise("pad_resize"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_epoch"), (k % 40).cast("string"))), F.lit("_"), k.cast("string"), F.lit(".pt"))
    return C.checkpoints(table(spark, sf_dir, "supplier").select(name.alias("path")), "path", "tiles", ["tiles", "pad_resize"], low=5, high=30).select("path", "mode", "epoch")


def column_modes(spark, sf_dir):
    n = F.col("n_nationkey")
    mode = F.element_at(F.array(*map(F.lit, C.COLUMN_MODES)), (n % 4 + 1).cast("int"))
    return C.checked_modes(table(spark, sf_dir, "nation").select(n.alias("nation"), (n % 10 + 1).alias("col"), mode.alias("mode")))


def gate_order(spark, sf_dir):
    gate = F.when(F.col("p_size") <= 3, F.element_at(F.array(*map(F.lit, ("Lymphocytes", "All Cells", "Singlets"))), F.col("p_size").cast("int"))).otherwise(F.col("p_brand"))
    gates = table(spark, sf_dir, "part").select(gate.alias("gate")).distinct()
    return gates.withColumn("place", F.row_number().over(Window.orderBy(T.gate_rank(F.col("gate")), "gate")))  # a row per gate


def texts(spark, sf_dir):
    p = F.col("o_totalprice")
    gone = F.when(F.col("o_orderkey") % 7 != 0, p)
    low, high = F.when(F.col("o_orderkey") % 3 == 0, p), F.when(F.col("o_orderkey") % 2 == 0, p)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.formatted(gone, 2).alias("number"), T.percent_with_range(gone, low, high, F.when(F.col("o_orderkey") % 5 == 0, p), 2).alias("percent"), T.decoded(F.encode("o_orderpriority", "UTF-8")).alias("priority"))


_TILES = f"""WITH {_px('a')}, {_px('b', 3)}, j AS (SELECT image, y, x, a.label AS a, b.label AS b FROM a JOIN b USING (image, y, x)),
t AS (SELECT image, y, x, 0 AS k, a > 0 AS t, b > 0 AS p FROM j WHERE y < 32 AND x < 32 UNION ALL SELECT image, y, x, 1, a % 3 = 1, b % 2 = 1 FROM j WHERE y >= 8 AND x >= 8),
g AS (SELECT image, y, x, count(*) AS n, bool_or(t) AS t, arg_min(p, k) AS p, CASE WHEN count(*) = 2 AND arg_min(t, k) <> arg_max(t, k) THEN 1 ELSE 0 END AS tc, CASE WHEN count(*) = 2 AND arg_min(p, k) <> arg_max(p, k) THEN 1 ELSE 0 END AS pc FROM t GROUP BY 1, 2, 3),
c AS (SELECT image, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) AS evaluated, CAST(sum(n - 1) AS BIGINT) AS overlap, CAST(sum(tc) AS BIGINT) AS truth_conflicts, CAST(sum(pc) AS BIGINT) AS predicted_conflicts FROM g GROUP BY 1)
SELECT *, round(2.0 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS jaccard, round(evaluated / 1600.0::DOUBLE, 6) AS coverage FROM c"""
_TOTALS = f"""WITH {_px('a')}, {_px('b', 3)}, j AS (SELECT image, y // 20 * 2 + x // 20 AS tile, coalesce(a.label > 0, false) AS t, coalesce(b.label > 0, false) AS p FROM a FULL JOIN b USING (image, y, x)),
c AS (SELECT image, count(DISTINCT tile) AS n_tiles, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY 1), d AS (SELECT *, n_tiles * 400 - tp - fp - fn AS tn FROM c)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS jaccard FROM d"""
_LOADED = """WITH d AS (SELECT doc_id, doc_id % 300 AS idx, lang AS mode, n_chars % 50 AS n, n_chars % 7 - 3 AS e FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 300, lang ORDER BY doc_id) = 1)
SELECT doc_id, idx, mode, 'imageJ' AS annotator, round(e / nullif(n, 0)::DOUBLE * 100.0, 6) AS count_error_pct, 'count_error_instances' AS count_error_pct_source, 'n_cells_gt_instances' AS count_error_pct_denominator FROM d"""
_SCORED = """WITH c AS (SELECT c_nationkey AS folder, c_custkey AS well_key, a.annotator, a.i, CASE WHEN c_custkey % 12 = 0 THEN 1 WHEN c_custkey % 12 = 1 THEN 8 ELSE [1, 2, 4, 6, 8][CAST((c_custkey * 7 + i) % 5 + 1 AS INTEGER)] END AS score FROM customer, (VALUES ('1', 0), ('2', 1), ('unet', 2), ('other', 3)) a(annotator, i))
SELECT folder, well_key, annotator, CAST(CASE WHEN annotator IN ('1', '2') OR well_key % 3 = 0 THEN score ELSE score + 1 END AS DOUBLE) AS evaluation FROM c"""
_FILES = """WITH p AS (SELECT 'models/unet_' || CASE WHEN s_suppkey % 2 = 0 THEN 'tiles' ELSE 'pad_resize' END || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '_epoch' || (s_suppkey % 40) END || '_' || s_suppkey || '.pt' AS path, s_suppkey % 2 = 0 AS tiles, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 40 AS INTEGER) END AS epoch FROM supplier)
SELECT path, 'tiles' AS mode, epoch FROM p WHERE tiles AND epoch BETWEEN 5 AND 30"""
_NUMBER = "CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE printf('%.2f', o_totalprice) END"
_PERCENT = "CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE printf('%.2f%%', o_totalprice) END"
QUERIES = {
    "val_tile_union": (tile_union, _TILES),
    "val_mask_totals": (mask_totals, _TOTALS),
    "val_prediction_rows": (prediction_rows, None),
    "val_centre_metrics": (centre_metrics, None),
    "val_loaded_errors": (loaded, _LOADED),
    "val_evaluation_scores": (evaluated, _SCORED),
    "flt_checkpoints": (checkpoints, _FILES),
    "prj_column_modes": (column_modes, "SELECT n_nationkey AS nation, n_nationkey % 10 + 1 AS col, ['T', 'B', 'T/B', 'empty'][CAST(n_nationkey % 4 + 1 AS INTEGER)] AS mode FROM nation"),
    "srt_gate_order": (gate_order, "WITH g AS (SELECT DISTINCT CASE p_size WHEN 1 THEN 'Lymphocytes' WHEN 2 THEN 'All Cells' WHEN 3 THEN 'Singlets' ELSE p_brand END AS gate FROM part) SELECT gate, CAST(row_number() OVER (ORDER BY CASE gate WHEN 'All Cells' THEN 0 WHEN 'Singlets' THEN 1 WHEN 'Lymphocytes' THEN 2 ELSE 3 END, lower(gate), gate) AS INTEGER) AS place FROM g"),
    "str_report_texts": (texts, f"SELECT o_orderkey, {_NUMBER} AS number, {_PERCENT} || CASE WHEN o_orderkey % 6 = 0 THEN printf(' (range: %.2f-%.2f%%)', o_totalprice, o_totalprice) WHEN o_orderkey % 5 = 0 THEN printf(' (range: %.2f%%)', o_totalprice) ELSE '' END AS percent, trim(o_orderpriority) AS priority FROM orders"),
}
