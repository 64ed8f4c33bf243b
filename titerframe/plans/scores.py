"""Queries of scored wells by all classifiers, back-filled scores, instance scores and paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, instances, rois
from .pixels import IMG, _pixels, _px
from .proxies import ROIS, table
from .proxies import rois as roi_table

P = ["plate"]
CLASSIFIERS = ("midpoint", "nc_upper", "pc_lower", "gaussian", "gaussian2")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def all_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells of every plate scored by each registered classifier."""
    out = None
    for name in CLASSIFIERS:
        one = rois.score_rois(roi_table(spark, sf_dir), P, 60, classifier=name)
        out = one if out is None else out.unionByName(one)
    return _r(out.select("classifier_method", "calib_method", "plate", "well", "n_rois", "frac_pos_raw", "corrected", "score", "adjusted_score"), "frac_pos_raw", "corrected")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of wells (customers) by two people and a method, in folders by nation."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    role = F.when(k % 12 == 0, "negative").when(k % 12 == 1, "positive").otherwise("sample")
    who = F.explode(F.array(*[F.struct(F.lit(n).alias("annotator"), F.lit(i).alias("i")) for i, n in enumerate(("1", "2", "unet", "other"))])).alias("a")
    rows = c.select(F.col("c_nationkey").alias("folder"), k.alias("well_key"), role.alias("role"), who, (F.abs("c_acctbal") / 100).alias("f"))
    steps = F.array(*map(F.lit, (1, 2, 4, 6, 8)))
    score = F.when(F.col("role") == "negative", 1).when(F.col("role") == "positive", 8).otherwise(F.element_at(steps, ((F.col("well_key") * 7 + F.col("a.i")) % 5 + 1).cast("int")))
    return rows.select("folder", "well_key", "role", "a.annotator", score.alias("score"), F.when(F.col("a.i") >= 2, F.col("f")).alias("frac_pos"))


def backfill(spark, sf_dir):
    rows, _ = rois.backfilled_scores(_ratings(spark, sf_dir), ["well_key", "annotator"], ["1", "2"], ["unet"])
    return _r(rows.select("folder", "well_key", "annotator", "score", "frac_pos", "pc_ref", "nc_ref", "corrected", "adjusted_score"), "frac_pos", "pc_ref", "nc_ref", "corrected")


def objects(spark, sf_dir):
    """Matched regions at all seven thresholds."""
    s = instances.object_scores(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)
    return _r(s, "precision", "recall", "f1", "mean_iou", "mean_dice", "mean_iou_all", "mean_dice_all", "pq")


def jaccard(spark, sf_dir):
    return _r(instances.aggregated_jaccard(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG), "aji", "matched_dice")


def centres(spark, sf_dir):
    return _r(instances.centre_scores(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG), "precision", "recall", "f1", "mean_error")


def centres_in_masks(spark, sf_dir):
    return _r(instances.centre_in_mask(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG), "precision", "recall", "f1")


def boundaries(spark, sf_dir):
    return _r(instances.boundary_scores(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG), "precision", "recall", "f1")


def heat_peaks(spark, sf_dir):
    return instances.peaks(_pixels(spark, sf_dir), IMG, "r", 30.0, 3).select("image", "y", "x", F.round("score", 6).alias("score"))


def paired(spark, sf_dir):
    """Signed ranks of two values of every document by language and source: small groups exactly, others by the normal form."""
    d = table(spark, sf_dir, "documents").select("lang", "source", ((F.col("doc_id") * 7919) % 10007).cast("double").alias("a"), ((F.col("n_chars") * 31 + F.col("doc_id")) % 9973).cast("double").alias("b"))
    return agreement.signed_ranks(d, ["lang", "source"], "a", "b").withColumn("p_value", F.round("p_value", 7))


_FIVE = f"""WITH {ROIS}, q0 AS (SELECT *, mean_r / greatest(1e-6, mean_g) AS q FROM ro), c AS (
  SELECT plate, (median(q) FILTER (role = 'positive') + median(q) FILTER (role = 'negative')) / 2 AS th,
         avg(q) FILTER (role = 'positive') AS mp, greatest(coalesce(stddev_samp(q) FILTER (role = 'positive'), 0), 1e-6) AS sp, avg(q) FILTER (role = 'negative') AS mn, greatest(coalesce(stddev_samp(q) FILTER (role = 'negative'), 0), 1e-6) AS sn,
         avg(mean_r) FILTER (role = 'positive') AS rp, avg(mean_g) FILTER (role = 'positive') AS gp, var_samp(mean_r) FILTER (role = 'positive') + 1e-6 AS rrp, var_samp(mean_g) FILTER (role = 'positive') + 1e-6 AS ggp, covar_samp(mean_r, mean_g) FILTER (role = 'positive') AS rgp,
         avg(mean_r) FILTER (role = 'negative') AS rn, avg(mean_g) FILTER (role = 'negative') AS gn, var_samp(mean_r) FILTER (role = 'negative') + 1e-6 AS rrn, var_samp(mean_g) FILTER (role = 'negative') + 1e-6 AS ggn, covar_samp(mean_r, mean_g) FILTER (role = 'negative') AS rgn
  FROM q0 GROUP BY plate HAVING count(DISTINCT well) = 60 AND count(*) FILTER (role = 'positive') > 0 AND count(*) FILTER (role = 'negative') > 0
), s AS (
  SELECT q0.*, th, mp, sp, mn, sn, -0.5 * ((ggp * (mean_r - rp) ** 2 - 2 * rgp * (mean_r - rp) * (mean_g - gp) + rrp * (mean_g - gp) ** 2) / (rrp * ggp - rgp * rgp) + ln(rrp * ggp - rgp * rgp))
         + 0.5 * ((ggn * (mean_r - rn) ** 2 - 2 * rgn * (mean_r - rn) * (mean_g - gn) + rrn * (mean_g - gn) ** 2) / (rrn * ggn - rgn * rgn) + ln(rrn * ggn - rgn * rgn)) AS s2
  FROM q0 JOIN c USING (plate)
), l AS (
  SELECT plate, well, role, 'midpoint' AS classifier_method, 'median' AS calib_method, CASE WHEN q >= th THEN 'pos' ELSE 'neg' END AS label FROM s
  UNION ALL SELECT plate, well, role, 'nc_upper', 'gaussian', CASE WHEN (q - mn) / sn >= 3 THEN 'pos' ELSE 'uncertain' END FROM s
  UNION ALL SELECT plate, well, role, 'pc_lower', 'gaussian', CASE WHEN (q - mp) / sp <= -3 THEN 'neg' ELSE 'uncertain' END FROM s
  UNION ALL SELECT plate, well, role, 'gaussian', 'gaussian', CASE WHEN (q - mn) / sn >= 2 THEN 'pos' WHEN (q - mp) / sp <= -2 THEN 'neg' ELSE 'uncertain' END FROM s
  UNION ALL SELECT plate, well, role, 'gaussian2', 'gaussian2', CASE WHEN s2 > 1.0 THEN 'pos' WHEN s2 < -1.0 THEN 'neg' ELSE 'uncertain' END FROM s
), w AS (
  SELECT classifier_method, calib_method, plate, well, role, count(*) AS n_rois, 100.0::DOUBLE * count(*) FILTER (label = 'pos') / nullif(count(*) FILTER (label <> 'uncertain'), 0) AS f FROM l GROUP BY ALL
), r AS (SELECT classifier_method, plate, avg(f) FILTER (role = 'positive') AS pc, avg(f) FILTER (role = 'negative') AS nc FROM w GROUP BY ALL
), k AS (SELECT w.*, CASE WHEN f IS NOT NULL AND pc <> nc THEN greatest(0.0, least(100.0, (f - nc) / (pc - nc) * 100.0)) END AS corrected FROM w JOIN r USING (classifier_method, plate))"""
_CDC = "CASE WHEN {0} <= 10 THEN 1 WHEN {0} <= 20 THEN 2 WHEN {0} <= 50 THEN 4 WHEN {0} <= 80 THEN 6 WHEN {0} IS NOT NULL THEN 8 END"
_BACK = f"""WITH c AS (
  SELECT c_nationkey AS folder, c_custkey AS well_key, CASE WHEN c_custkey % 12 = 0 THEN 'negative' WHEN c_custkey % 12 = 1 THEN 'positive' ELSE 'sample' END AS role, a.annotator, a.i, abs(c_acctbal) / 100 AS f
  FROM customer, (VALUES ('1', 0), ('2', 1), ('unet', 2), ('other', 3)) a(annotator, i)
), s AS (SELECT *, CASE role WHEN 'negative' THEN 1 WHEN 'positive' THEN 8 ELSE [1, 2, 4, 6, 8][CAST((well_key * 7 + i) % 5 + 1 AS INTEGER)] END AS score FROM c
), u AS (SELECT *, CAST(('0x' || substr(md5('0|' || CAST(well_key AS VARCHAR) || '|' || annotator), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s
), g AS (SELECT folder, well_key, role, annotator, score, CASE WHEN i >= 2 THEN f ELSE CASE score WHEN 1 THEN 10 * u WHEN 2 THEN 10 + 10 * u WHEN 4 THEN 20 + 20 * u WHEN 6 THEN 40 + 20 * u ELSE 80 + 20 * u END END AS frac_pos FROM u
), r AS (SELECT folder, annotator, avg(frac_pos) FILTER (role = 'positive') AS pc_ref, avg(frac_pos) FILTER (role = 'negative') AS nc_ref FROM g WHERE annotator <> 'other' GROUP BY 1, 2
), k AS (SELECT g.*, pc_ref, nc_ref, CASE WHEN annotator <> 'other' AND pc_ref <> nc_ref THEN greatest(0.0, least(100.0, (frac_pos - nc_ref) / (pc_ref - nc_ref) * 100.0)) END AS corrected FROM g LEFT JOIN r USING (folder, annotator))
SELECT folder, well_key, annotator, score, round(frac_pos, 6) AS frac_pos, round(pc_ref, 6) AS pc_ref, round(nc_ref, 6) AS nc_ref, round(corrected, 6) AS corrected, {_CDC.format('corrected')} AS adjusted_score FROM k"""
_EDGE = "{0}e AS (SELECT p.image, p.y, p.x FROM {0} p WHERE p.label > 0 AND (SELECT count(*) FROM {0} q WHERE q.image = p.image AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.label > 0) < 9)"
_RATES = "CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"
def signed_rank_sql(d: str, keys: str, digits: int) -> str:
    """Signed ranks by ``keys`` of the CTE list ``d``, whose last table is d(keys, d)."""
    same = " AND ".join(f"{{0}}.{k} IS NOT DISTINCT FROM {{1}}.{k}" for k in keys.split(", "))
    of = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    return f"""{d}, z AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM d WHERE d <> 0
), w AS (SELECT {keys}, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS s, sum(t * t - 1) AS ties FROM z GROUP BY ALL
), n AS (SELECT {keys}, count(*) AS n_paired, count(*) FILTER (d <> 0) AS n FROM d GROUP BY ALL
), m AS (SELECT {of('n')}, n_paired, n, s, ties, abs(s - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS z FROM n LEFT JOIN w ON {same.format('n', 'w')}
), x AS (SELECT CAST(unnest(range(2001)) AS INTEGER) AS k
), p AS (  -- Simpson's rule over the density
  SELECT {keys}, n_paired, n, s, ties, 1 - 2 * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (z * k / 2000) ** 2)) * z / 6000 / sqrt(2 * pi()) AS normal FROM m, x GROUP BY {keys}, n_paired, n, s, ties, z
), e AS (  -- ways to a sum of ranks, for 0 to 50 pairs
  WITH RECURSIVE c(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range((n + 1) * (n + 2) // 2 + 1), lambda v: coalesce(c[v + 1], 0) + CASE WHEN v > n THEN coalesce(c[v - n], 0) ELSE 0 END) FROM c WHERE n < 50)
  SELECT n, c FROM c)
SELECT {keys}, n_paired, p.n AS n_nonzero, round(s, 6) AS statistic,
       CASE WHEN n_paired >= 3 AND s IS NOT NULL THEN round(least(1.0, CASE WHEN ties = 0 AND p.n = n_paired AND p.n <= 50 THEN 2 * list_sum(list_slice(e.c, 1, CAST(s AS BIGINT) + 1)) / 2 ** p.n ELSE normal END), {digits}) END AS p_value
FROM p LEFT JOIN e ON e.n = p.n"""


_RANKS = signed_rank_sql("WITH d AS (SELECT lang, source, CAST((doc_id * 7919) % 10007 AS DOUBLE) - CAST((n_chars * 31 + doc_id) % 9973 AS DOUBLE) AS d FROM documents)", "lang, source", 7)

QUERIES = {
    "cdc_all_classifiers": (all_classifiers, f"{_FIVE} SELECT classifier_method, calib_method, plate, well, n_rois, round(f, 6) AS frac_pos_raw, round(corrected, 6) AS corrected, {_CDC.format('f')} AS score, {_CDC.format('corrected')} AS adjusted_score FROM k"),
    "val_score_backfill": (backfill, _BACK),
    "val_object_scores": (objects, None),
    "val_aggregated_jaccard": (jaccard, None),
    "val_centre_scores": (centres, None),
    "val_centres_in_masks": (
        centres_in_masks,
        f"""WITH {_px('a')}, {_px('b', 3)}, c AS (SELECT image, label, avg(y) AS cy, avg(x) AS cx FROM a WHERE label > 0 GROUP BY 1, 2),
p AS (SELECT a.image, a.label, arg_min({{'y': y, 'x': x}}, {{'far': CASE WHEN y = round_even(cy, 0) AND x = round_even(cx, 0) THEN 0 ELSE 1 END, 'd': (y - cy) ** 2 + (x - cx) ** 2, 'y': y, 'x': x}}) AS p FROM a JOIN c USING (image, label) GROUP BY 1, 2),
h AS (SELECT p.image, count(DISTINCT b.label) AS tp FROM p JOIN b ON b.image = p.image AND b.y = p.p.y AND b.x = p.p.x WHERE b.label > 0 GROUP BY 1),
n AS (SELECT image, count(DISTINCT a.label) FILTER (a.label > 0) AS nt, count(DISTINCT b.label) FILTER (b.label > 0) AS np FROM a FULL JOIN b USING (image, y, x) GROUP BY 1),
t AS (SELECT image, nt AS n_truth, np AS n_predicted, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, nt - coalesce(tp, 0) AS fn FROM n LEFT JOIN h USING (image)) SELECT image, n_truth, n_predicted, tp, fp, fn, {_RATES} FROM t""",
    ),
    "val_boundary_scores": (
        boundaries,
        f"""WITH {_px('a')}, {_px('b', 3)}, {_EDGE.format('a')}, {_EDGE.format('b')},
r AS (SELECT p.image, avg(EXISTS (SELECT 1 FROM ae q WHERE q.image = p.image AND (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= 4)::INT) AS precision FROM be p GROUP BY 1),
s AS (SELECT p.image, avg(EXISTS (SELECT 1 FROM be q WHERE q.image = p.image AND (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= 4)::INT) AS recall FROM ae p GROUP BY 1)
SELECT image, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r JOIN s USING (image)""",
    ),
    "val_peaks": (
        heat_peaks,
        f"WITH {_px('a')} SELECT p.image AS image, p.y AS y, p.x AS x, round(p.r, 6) AS score FROM a p WHERE p.r >= 30.0 AND NOT EXISTS (SELECT 1 FROM a q WHERE q.image = p.image AND abs(q.y - p.y) <= 3 AND abs(q.x - p.x) <= 3 AND q.r > p.r)",
    ),
    "val_paired_tests": (paired, _RANKS),
}
