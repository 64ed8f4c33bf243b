"""Plate queries: ROI calibration and classification, wells, panel reactivity, crossmatch, alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import assay, rois
from .proxies import LAYOUT, ROIS, layout, table
from .proxies import rois as roi_table

P = ["plate"]


def _r(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c in cols})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ro = roi_table(spark, sf_dir)
    return rois.score_gaussian2(ro, rois.calibrate_gaussian2(ro, P), P)


def _wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rois.corrected_wells(rois.well_summary(_labelled(spark, sf_dir), ["plate", "well", "role"]), P)


def _called(spark, sf_dir, manual: bool = True) -> DataFrame:
    w = _wells(spark, sf_dir)
    over = _overrides(spark, sf_dir) if manual else None
    return assay.overlay(w, over, ["plate", "well"])


def _overrides(spark, sf_dir) -> DataFrame:
    """Every plate's wells C3 and D4 have histories; the latest order decides."""
    ro = roi_table(spark, sf_dir).where(F.col("well").isin("C3", "D4"))
    made = F.when(F.col("roi_id") % 2 == 0, "positive").otherwise("negative")
    return assay.last_overrides(ro.select("plate", "well", "seen_at", "roi_id", made.alias("made")), ["plate", "well"], ["seen_at", "roi_id"], "made")


_CAL = f"""WITH {ROIS}, cal AS (
  SELECT plate, avg(mean_r) FILTER (role = 'positive') AS r_pc, avg(mean_g) FILTER (role = 'positive') AS g_pc, var_samp(mean_r) FILTER (role = 'positive') + 1e-6 AS rr_pc, var_samp(mean_g) FILTER (role = 'positive') + 1e-6 AS gg_pc, covar_samp(mean_r, mean_g) FILTER (role = 'positive') AS rg_pc,
         avg(mean_r) FILTER (role = 'negative') AS r_nc, avg(mean_g) FILTER (role = 'negative') AS g_nc, var_samp(mean_r) FILTER (role = 'negative') + 1e-6 AS rr_nc, var_samp(mean_g) FILTER (role = 'negative') + 1e-6 AS gg_nc, covar_samp(mean_r, mean_g) FILTER (role = 'negative') AS rg_nc
  FROM ro GROUP BY plate
)"""
_LAB = f"""{_CAL}, sc AS (
  SELECT ro.*, -0.5 * ((gg_pc * (mean_r - r_pc) ** 2 - 2 * rg_pc * (mean_r - r_pc) * (mean_g - g_pc) + rr_pc * (mean_g - g_pc) ** 2) / (rr_pc * gg_pc - rg_pc * rg_pc) + ln(rr_pc * gg_pc - rg_pc * rg_pc))
         + 0.5 * ((gg_nc * (mean_r - r_nc) ** 2 - 2 * rg_nc * (mean_r - r_nc) * (mean_g - g_nc) + rr_nc * (mean_g - g_nc) ** 2) / (rr_nc * gg_nc - rg_nc * rg_nc) + ln(rr_nc * gg_nc - rg_nc * rg_nc)) AS score
  FROM ro LEFT JOIN cal USING (plate)
), lb AS (SELECT *, CASE WHEN score > 1.0 THEN 'pos' WHEN score < -1.0 THEN 'neg' ELSE 'uncertain' END AS label FROM sc
), wl AS (
  SELECT plate, well, role, count(*) AS n_rois, count(*) FILTER (label = 'pos') AS n_pos, count(*) FILTER (label = 'neg') AS n_neg, count(*) FILTER (label = 'uncertain') AS n_uncertain FROM lb GROUP BY plate, well, role
), wf AS (
  SELECT *, 100.0::DOUBLE * n_pos / nullif(n_pos + n_neg, 0) AS frac_pos_raw, 100.0::DOUBLE * n_pos / n_rois AS frac_pos, n_uncertain / n_rois AS frac_uncertain FROM wl
), rf AS (SELECT plate, avg(frac_pos_raw) FILTER (role = 'positive') AS pc_ref, avg(frac_pos_raw) FILTER (role = 'negative') AS nc_ref FROM wf GROUP BY plate
), wc AS (
  SELECT wf.*, pc_ref, nc_ref, CASE WHEN frac_pos_raw IS NOT NULL AND pc_ref <> nc_ref THEN greatest(0.0, least(100.0, (frac_pos_raw - nc_ref) / (pc_ref - nc_ref) * 100.0)) END AS corrected FROM wf JOIN rf USING (plate)
), ov AS (
  SELECT plate, well, arg_max(CASE WHEN roi_id % 2 = 0 THEN 'positive' ELSE 'negative' END, (seen_at, roi_id)) AS manual_call, count(*) AS n_changes FROM ro WHERE well IN ('C3', 'D4') GROUP BY plate, well
), ca AS (
  SELECT wc.*, CASE WHEN corrected IS NULL THEN 'not_available' WHEN corrected >= 20 THEN 'positive' ELSE 'negative' END AS automated_call, manual_call IS NOT NULL AS manual,
         coalesce(manual_call, CASE WHEN corrected IS NULL THEN 'not_available' WHEN corrected >= 20 THEN 'positive' ELSE 'negative' END) AS effective_call
  FROM wc LEFT JOIN ov USING (plate, well)
)"""
_SCORE = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= 10 THEN 1 WHEN {0} <= 20 THEN 2 WHEN {0} <= 50 THEN 4 WHEN {0} <= 80 THEN 6 ELSE 8 END"
_RG = f"WITH {ROIS}, rg AS (SELECT *, mean_r / greatest(1e-6, mean_g) AS q FROM ro)"


def roi_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("plate", "role", "label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


def wells(spark, sf_dir):
    w = _wells(spark, sf_dir).select("plate", "well", "role", "n_rois", "n_pos", "n_neg", "n_uncertain", "frac_pos_raw", "frac_pos", "corrected", "score", "adjusted_score")
    return _r(w, "frac_pos_raw", "frac_pos", "corrected")


def gaussian2(spark, sf_dir):
    c = rois.calibrate_gaussian2(roi_table(spark, sf_dir), P)
    return _r(c, *[x for x in c.columns if x != "plate"])


def midpoints(spark, sf_dir):
    ro = roi_table(spark, sf_dir)
    a = rois.calibrate_midpoint(ro, P).select("plate", F.round("threshold", 6).alias("by_median"))
    return a.join(rois.calibrate_midpoint(ro, P, "mean").select("plate", F.round("threshold", 6).alias("by_mean")), "plate")


def one_dimensional(spark, sf_dir):
    """The classifiers on the red/green ratio side by side: counts of positives, negatives and undecided."""
    ro = roi_table(spark, sf_dir)
    cal = rois.calibrate_gaussian(ro, P).join(rois.calibrate_midpoint(ro, P).select("plate", "threshold"), "plate")
    q = N.red_green_ratio(F.col("mean_r"), F.col("mean_g"))
    j = ro.join(F.broadcast(cal), "plate").withColumn("q", q)  # a row per plate
    c = F.col
    labels = {
        "midpoint": rois.label_threshold(c("q"), c("threshold")), "nc_upper": rois.label_above_negative(c("q"), c("mu_nc"), c("sd_nc")),
        "pc_lower": rois.label_below_positive(c("q"), c("mu_pc"), c("sd_pc")), "gaussian": rois.label_gaussian(c("q"), c("mu_nc"), c("sd_nc"), c("mu_pc"), c("sd_pc")),
    }
    aggs = [F.count_if(x == v).alias(f"{name}_{v}") for name, x in labels.items() for v in ("pos", "neg")]
    return j.groupBy("plate").agg(F.count("*").alias("n"), *aggs)


def pra(spark, sf_dir):
    w = _called(spark, sf_dir).where("role = 'sample'")
    p = _r(assay.panel_reactivity(w, P), "pra_percent", "mean_corrected", "median_corrected", "max_corrected")
    return p.withColumns({c: F.array_join(c, ",") for c in ("positive_ids", "negative_ids", "borderline_ids")})


def pra_all_wells(spark, sf_dir):
    return _r(assay.reactivity_score(_called(spark, sf_dir).where("role = 'sample'"), P), "score_percent")


def xm(spark, sf_dir):
    w = _called(spark, sf_dir).where("role = 'sample'").withColumn("row", F.substring("well", 1, 1))
    return _r(assay.crossmatch(w, ["plate", "row"]), "mean_corrected", "mean_raw", "margin", "replicate_sd", "replicate_range")


def xm_modes(spark, sf_dir):
    """Columns 1-3 T, 4-6 B, the others T/B."""
    col = N.well_column(F.col("well"))
    w = _called(spark, sf_dir, manual=False).where("role = 'sample'")
    w = w.withColumn("mode", F.when(col <= 3, "T").when(col <= 6, "B").otherwise("T/B"))
    x = assay.crossmatch_by_mode(w, "mode")
    return _r(x.select("mode", "n_wells", "final_call", "mean_corrected", "replicate_range", "discordant"), "mean_corrected", "replicate_range")


def validity(spark, sf_dir):
    v = assay.run_validity(_wells(spark, sf_dir), P)
    v = _r(v, "pc_mean", "nc_mean", "pc_range", "nc_range", "dynamic_range").withColumn("warnings", F.array_join("warnings", "; "))
    return v


def alleles(spark, sf_dir):
    w = _called(spark, sf_dir).where("role = 'sample'")
    e = assay.allele_evidence(layout(spark, sf_dir), w, P)
    return _r(e, "fraction").withColumns({c: F.array_join(c, ",") for c in ("positive_ids", "negative_ids", "missing_ids")})


def matrix(spark, sf_dir):
    m = assay.plate_matrix(_wells(spark, sf_dir), P, "adjusted_score")
    return m.select("plate", "row", *[F.col(str(i)).alias(f"c{i}") for i in range(1, 11)])


def override_state(spark, sf_dir):
    return _overrides(spark, sf_dir)


def roles(spark, sf_dir):
    return assay.role_counts(_called(spark, sf_dir), P)


def scan_order(spark, sf_dir):
    return assay.acquisition_order(roi_table(spark, sf_dir).select("plate", "well").distinct(), P)


def qc_flags(spark, sf_dir):
    from ..operators.statistics import with_mad

    ro = roi_table(spark, sf_dir)
    stats = with_mad(ro, P, "area", "med", "mad")
    j = ro.join(F.broadcast(stats), P).withColumn("z", 0.6745 * (F.col("area") - F.col("med")) / (F.col("mad") + 1e-6))
    q = rois.qc_reasons(j, F.col("z"), F.col("roi_id") % 11 == 0, F.col("roi_id") % 13 == 0, limit=1.2)
    return q.groupBy("plate", F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("n"), F.count_if("excluded").alias("n_excluded"))


_XMC = """count(*) AS n_wells, avg(corrected) AS mc, avg(frac_pos_raw) AS mr, stddev_samp(corrected) AS sd, max(corrected) - min(corrected) AS rr, count(*) FILTER (effective_call = 'positive') AS np, count(*) FILTER (effective_call = 'negative') AS nn,
  count(*) FILTER (manual) AS nm, count(*) FILTER (manual AND effective_call = 'positive') AS mp, count(*) FILTER (manual AND effective_call = 'negative') AS mn, count(*) FILTER (corrected BETWEEN 15 AND 25) AS nb"""
_BYMEAN = "CASE WHEN mc IS NULL THEN 'not_available' WHEN mc >= 20 THEN 'positive' ELSE 'negative' END"

QUERIES = {
    "cdc_roi_labels": (roi_labels, f"{_LAB} SELECT plate, role, label, count(*) AS n, round(avg(score), 5) AS mean_score FROM lb GROUP BY plate, role, label"),
    "cdc_wells": (wells, f"{_LAB} SELECT plate, well, role, n_rois, n_pos, n_neg, n_uncertain, round(frac_pos_raw, 6) AS frac_pos_raw, round(frac_pos, 6) AS frac_pos, round(corrected, 6) AS corrected, {_SCORE.format('frac_pos_raw')} AS score, {_SCORE.format('corrected')} AS adjusted_score FROM wc"),
    "cdc_calibrate_gaussian2": (gaussian2, f"{_CAL} SELECT plate, " + ", ".join(f"round({c}_{n}, 6) AS {c}_{n}" for n in ("pc", "nc") for c in ("r", "g", "rr", "gg", "rg")) + " FROM cal"),
    "cdc_calibrate_midpoint": (midpoints, f"{_RG} SELECT plate, round((median(q) FILTER (role = 'positive') + median(q) FILTER (role = 'negative')) / 2, 6) AS by_median, round((avg(q) FILTER (role = 'positive') + avg(q) FILTER (role = 'negative')) / 2, 6) AS by_mean FROM rg GROUP BY plate"),
    "cdc_classifiers": (one_dimensional, f"""{_RG}, c AS (
  SELECT plate, avg(q) FILTER (role = 'positive') AS mp, greatest(stddev_samp(q) FILTER (role = 'positive'), 1e-6) AS sp, avg(q) FILTER (role = 'negative') AS mn, greatest(stddev_samp(q) FILTER (role = 'negative'), 1e-6) AS sn,
         (median(q) FILTER (role = 'positive') + median(q) FILTER (role = 'negative')) / 2 AS th FROM rg GROUP BY plate)
SELECT rg.plate AS plate, count(*) AS n, count(*) FILTER (q >= th) AS midpoint_pos, count(*) FILTER (q < th) AS midpoint_neg, count(*) FILTER ((q - mn) / sn >= 3) AS nc_upper_pos, 0::BIGINT AS nc_upper_neg, 0::BIGINT AS pc_lower_pos,
  count(*) FILTER ((q - mp) / sp <= -3) AS pc_lower_neg, count(*) FILTER ((q - mn) / sn >= 2) AS gaussian_pos, count(*) FILTER ((q - mn) / sn < 2 AND (q - mp) / sp <= -2) AS gaussian_neg
FROM rg JOIN c USING (plate) GROUP BY rg.plate"""),
    "cdc_pra": (pra, f"""{_LAB} SELECT plate, count(*) AS valid_wells, count(*) FILTER (effective_call = 'positive') AS positive_wells, round(100.0::DOUBLE * count(*) FILTER (effective_call = 'positive') / count(*), 6) AS pra_percent,
  round(avg(corrected), 6) AS mean_corrected, round(median(corrected), 6) AS median_corrected, round(max(corrected), 6) AS max_corrected, count(*) FILTER (effective_call = 'positive' AND corrected < 40) AS n_weak,
  count(*) FILTER (effective_call = 'positive' AND corrected >= 40 AND corrected < 70) AS n_moderate, count(*) FILTER (effective_call = 'positive' AND corrected >= 70) AS n_strong, count(*) FILTER (corrected BETWEEN 15 AND 25) AS n_borderline,
  coalesce(string_agg(well, ',' ORDER BY well) FILTER (effective_call = 'positive'), '') AS positive_ids, coalesce(string_agg(well, ',' ORDER BY well) FILTER (effective_call = 'negative'), '') AS negative_ids,
  coalesce(string_agg(well, ',' ORDER BY well) FILTER (corrected BETWEEN 15 AND 25), '') AS borderline_ids, count(*) FILTER (manual) AS n_manual
FROM ca WHERE role = 'sample' AND corrected IS NOT NULL GROUP BY plate"""),
    "cdc_pra_all_wells": (pra_all_wells, f"{_LAB} SELECT plate, count(*) AS total_wells, count(*) FILTER (effective_call = 'positive') AS positive_wells, count(*) FILTER (effective_call = 'not_available') AS missing_wells, round(100.0::DOUBLE * count(*) FILTER (effective_call = 'positive') / count(*), 6) AS score_percent FROM ca WHERE role = 'sample' GROUP BY plate"),
    "cdc_crossmatch": (xm, f"""{_LAB}, g AS (SELECT plate, left(well, 1) AS "row", {_XMC} FROM ca WHERE role = 'sample' GROUP BY 1, 2)
SELECT plate, "row", n_wells, CASE WHEN nm > 0 AND np + nn > 0 THEN CASE WHEN np > nn THEN 'positive' WHEN nn > np THEN 'negative' WHEN mp > mn THEN 'positive' WHEN mn > mp THEN 'negative' ELSE {_BYMEAN} END ELSE {_BYMEAN} END AS final_call,
  CASE WHEN nm > 0 AND np + nn > 0 THEN 'effective_well_calls' ELSE 'measured_mean' END AS call_source, round(mc, 6) AS mean_corrected, round(mr, 6) AS mean_raw, round(mc - 20, 6) AS margin, round(sd, 6) AS replicate_sd, round(rr, 6) AS replicate_range,
  coalesce(rr > 20, false) AS discordant, coalesce(mc BETWEEN 15 AND 25, false) AS borderline, nb AS n_borderline, nm AS n_manual FROM g"""),
    "cdc_crossmatch_modes": (xm_modes, f"""{_LAB}, m AS (SELECT *, CASE WHEN CAST(substr(well, 2) AS INTEGER) <= 3 THEN 'T' WHEN CAST(substr(well, 2) AS INTEGER) <= 6 THEN 'B' ELSE 'T/B' END AS mode FROM wc WHERE role = 'sample'),
g AS (SELECT mode, count(*) AS n_wells, avg(corrected) AS mc, max(corrected) - min(corrected) AS rr FROM m GROUP BY GROUPING SETS ((mode), ()))
SELECT mode, n_wells, {_BYMEAN} AS final_call, round(mc, 6) AS mean_corrected, round(rr, 6) AS replicate_range, coalesce(rr > 20, false) AS discordant FROM g"""),
    "cdc_run_validity": (validity, f"""{_LAB}, g AS (
  SELECT plate, avg(frac_pos_raw) FILTER (role = 'positive') AS pm, avg(frac_pos_raw) FILTER (role = 'negative') AS nm, max(frac_pos_raw) FILTER (role = 'positive') - min(frac_pos_raw) FILTER (role = 'positive') AS pr, max(frac_pos_raw) FILTER (role = 'negative') - min(frac_pos_raw) FILTER (role = 'negative') AS nr,
         count(*) FILTER (role = 'positive') AS n_pc, count(*) FILTER (role = 'negative') AS n_nc, count(*) FILTER (n_rois < 50) AS n_low_roi, count(*) FILTER (frac_uncertain > 0.25) AS n_high_uncertain FROM wc GROUP BY plate),
w AS (SELECT *, concat_ws('; ', CASE WHEN n_pc = 0 THEN 'no positive control' END, CASE WHEN n_nc = 0 THEN 'no negative control' END, CASE WHEN coalesce(pm - nm < 30, true) THEN 'poor separation' END, CASE WHEN pr > 20 THEN 'positive controls differ' END, CASE WHEN nr > 20 THEN 'negative controls differ' END) AS warnings FROM g)
SELECT plate, round(pm, 6) AS pc_mean, round(nm, 6) AS nc_mean, round(pr, 6) AS pc_range, round(nr, 6) AS nc_range, n_pc, n_nc, n_low_roi, n_high_uncertain, round(pm - nm, 6) AS dynamic_range, warnings,
  CASE WHEN warnings <> '' THEN 'invalid' WHEN n_low_roi + n_high_uncertain > 0 THEN 'warning' ELSE 'valid' END AS status FROM w"""),
    "cdc_allele_evidence": (alleles, f"""{_LAB}, {LAYOUT}, sw AS (SELECT * FROM ca WHERE role = 'sample'), k AS (SELECT p.plate, lay.* FROM lay CROSS JOIN (SELECT DISTINCT plate FROM sw) p)
SELECT k.plate AS plate, locus, allele, count(*) AS total, count(*) FILTER (effective_call = 'positive') AS n_pos, count(*) FILTER (effective_call = 'negative') AS n_neg, coalesce(string_agg(k.well, ',' ORDER BY k.well) FILTER (effective_call = 'positive'), '') AS positive_ids,
  coalesce(string_agg(k.well, ',' ORDER BY k.well) FILTER (effective_call = 'negative'), '') AS negative_ids, coalesce(string_agg(k.well, ',' ORDER BY k.well) FILTER (effective_call IS NULL OR effective_call = 'not_available'), '') AS missing_ids,
  round(count(*) FILTER (effective_call = 'positive') / count(*), 6) AS fraction, CAST(count(*) FILTER (effective_call = 'positive') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS ratio
FROM k LEFT JOIN sw ON sw.plate = k.plate AND sw.well = k.well GROUP BY k.plate, locus, allele"""),
    "cdc_plate_matrix": (matrix, f"{_LAB}, s AS (SELECT *, {_SCORE.format('corrected')} AS a FROM wc) SELECT plate, left(well, 1) AS \"row\", " + ", ".join(f"max(a) FILTER (CAST(substr(well, 2) AS INTEGER) = {i}) AS c{i}" for i in range(1, 11)) + " FROM s GROUP BY 1, 2"),
    "cdc_override_state": (override_state, f"{_LAB} SELECT plate, well, manual_call, n_changes FROM ov"),
    "cdc_role_counts": (roles, f"{_LAB} SELECT plate, role, count(*) AS n_wells, count(*) FILTER (effective_call = 'positive') AS n_positive FROM ca GROUP BY plate, role"),
    "cdc_scan_order": (scan_order, f"WITH {ROIS}, d AS (SELECT DISTINCT plate, well FROM ro) SELECT plate, well, CAST(row_number() OVER (PARTITION BY plate ORDER BY CAST(substr(well, 2) AS INTEGER), CASE WHEN CAST(substr(well, 2) AS INTEGER) % 2 = 1 THEN ascii(well) ELSE -ascii(well) END) AS INTEGER) AS scan FROM d"),
    "cdc_roi_qc": (qc_flags, f"""WITH {ROIS}, m AS (SELECT plate, median(area) AS med FROM ro GROUP BY plate), d AS (SELECT ro.plate, first(med) AS med, median(abs(area - med)) AS mad FROM ro JOIN m USING (plate) GROUP BY ro.plate),
z AS (SELECT ro.plate, concat_ws('+', CASE WHEN roi_id % 11 = 0 THEN 'touching' END, CASE WHEN roi_id % 13 = 0 THEN 'border' END, CASE WHEN abs(0.6745 * (area - med) / (mad + 1e-6)) > 1.2 THEN 'area' END) AS reasons FROM ro JOIN d USING (plate))
SELECT plate, reasons, count(*) AS n, count(*) FILTER (reasons <> '') AS n_excluded FROM z GROUP BY plate, reasons"""),
}
