"""Event-level queries: gates, controls, readouts, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import numeric as N
from ..operators import gates, mixture_gates, readouts, sampling, statistics
from ..operators.staging import staged
from .proxies import EVENTS, IGG_COFACTOR, PNR, SINGLETS, events

R = 6
KEY = ["l_orderkey", "l_linenumber"]


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.withColumns({"edge": gates.edge_gate(["fsc_a", "ssc_a", "fsc_h"], PNR), "t": N.asinh_t(F.col("igg"), IGG_COFACTOR)})


def _singlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.singlets_mad(_gated(spark, sf_dir), "file_id", "fsc_a", "fsc_h")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cols})


METRICS = ("pos_fraction", "median_raw", "median_t", "median_shift", "median_ratio", "fluorescence_index")


def _nested() -> dict[str, Column]:
    return {"All Cells": F.col("edge"), "Singlets": F.col("edge") & F.col("singlet")}


def _nested_readout(spark: SparkSession, sf_dir: str, key: str, pooled: bool = False) -> DataFrame:
    """Readouts of nested gates; the gated events are written once and read for the controls and for the readouts."""
    ev = staged(_singlets(spark, sf_dir).select(key, "role", "igg", "t", "edge", "singlet"), "gated")
    controls = readouts.control_stats(gates.explode_gates(ev, _nested()), "gate", "role", "igg", "t")
    return _rounded(readouts.readouts_of_gates(ev, [key], _nested(), "igg", "t", controls, pooled), *METRICS)


def population_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readouts per file and gate against pooled controls: the flagship."""
    return _nested_readout(spark, sf_dir, "file_id")


_LONG = f"""WITH {EVENTS}, {SINGLETS}, lg AS (
  SELECT *, 'All Cells' AS gate FROM sing WHERE edge UNION ALL SELECT *, 'Singlets' AS gate FROM sing WHERE edge AND singlet
)"""
_CUTOFF = """
cnt AS (SELECT gate, count(*) FILTER (role = 'NC') AS n_nc, count(*) FILTER (role = 'PC') AS n_pc FROM lg GROUP BY gate
), us AS (SELECT lg.gate, lg.role, lg.t FROM lg JOIN cnt USING (gate) WHERE role = 'NC' OR (role = 'PC' AND n_pc >= 2000)
), rg0 AS (SELECT gate, quantile_cont(t, 0.001) AS a, quantile_cont(t, 0.999) AS b, min(t) AS mn, max(t) AS mx FROM us GROUP BY gate
), rg1 AS (SELECT gate, CASE WHEN b <= a THEN mn ELSE a END AS a, CASE WHEN b <= a THEN mx ELSE b END AS b FROM rg0
), rg2 AS (SELECT gate, a, CASE WHEN b <= a THEN a + 1.0 ELSE b END AS b FROM rg1
), rg AS (SELECT gate, a - 0.02 * (b - a) AS lo, b + 0.02 * (b - a) AS hi, ((b + 0.02 * (b - a)) - (a - 0.02 * (b - a))) / 256 AS w FROM rg2
), hb AS (
  SELECT us.gate, CAST(least(floor((t - lo) / w), 255) AS INTEGER) AS bin, count(*) FILTER (role = 'NC') AS nc, count(*) FILTER (role = 'PC') AS pc
  FROM us JOIN rg USING (gate) WHERE t >= lo AND t <= hi GROUP BY 1, 2
), gr AS (
  SELECT rg.gate, lo, w, b.bin, coalesce(nc, 0) AS nc, coalesce(pc, 0) AS pc FROM rg CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN hb ON hb.gate = rg.gate AND hb.bin = b.bin
), sm AS (
  SELECT *, sum(nc) OVER k / 7.0::DOUBLE AS s_nc, sum(pc) OVER k / 7.0::DOUBLE AS s_pc FROM gr WINDOW k AS (PARTITION BY gate ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
), pk AS (
  SELECT *, max(s_nc) OVER g AS peak, arg_min(bin, (-s_nc, bin)) OVER g AS peak_bin, s_nc / greatest(1.0, sum(s_nc) OVER g) AS d_nc, s_pc / greatest(1.0, sum(s_pc) OVER g) AS d_pc
  FROM sm WINDOW g AS (PARTITION BY gate)
), rn AS (
  SELECT *, sum(CASE WHEN s_nc <= 0.15 * peak AND bin > peak_bin THEN 1 ELSE 0 END) OVER (PARTITION BY gate ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AS in_run,
         bin > peak_bin AND bin < 255 AND d_pc >= d_nc AND s_nc <= 0.25 * peak AS crosses
  FROM pk
), fd AS (SELECT gate, lo, w, min(bin - 3) FILTER (in_run) AS tail_bin, min(bin) FILTER (crosses) AS cross_bin FROM rn GROUP BY gate, lo, w
), fb AS (SELECT gate, quantile_cont(t, 0.90) AS fallback FROM lg WHERE role = 'NC' GROUP BY gate
), cu AS (
  SELECT cnt.gate, n_nc, n_pc, CASE WHEN n_nc >= 2000 THEN coalesce(lo + (coalesce(CASE WHEN n_pc >= 2000 THEN cross_bin END, tail_bin) + 0.5) * w, fallback) ELSE coalesce(fallback, 0.0) END AS cutoff
  FROM cnt LEFT JOIN fd USING (gate) LEFT JOIN fb USING (gate)
), ct AS (
  SELECT lg.gate, median(igg) FILTER (role = 'NC') AS nc, median(t) FILTER (role = 'NC') AS nc_t, median(igg) FILTER (role = 'PC') AS pc, median(t) FILTER (role = 'PC') AS pc_t FROM lg GROUP BY lg.gate
)"""
_READ = """count(*) AS n_events, round(count(*) FILTER (t > cutoff) / count(*), 6) AS pos_fraction, round(median(igg), 6) AS median_raw, round(median(t), 6) AS median_t,
       round(median(igg) - first(nc), 6) AS median_shift, round(median(igg) / CASE WHEN abs(first(nc)) >= 1e-12 THEN first(nc) END, 6) AS median_ratio,
       round((median(igg) - first(nc)) / CASE WHEN abs(first(pc) - first(nc)) >= 1e-12 THEN first(pc) - first(nc) END * 100.0, 6) AS fluorescence_index"""
POPULATION_SQL = f"{_LONG}, {_CUTOFF} SELECT file_id, lg.gate AS gate, {_READ} FROM lg JOIN cu USING (gate) JOIN ct USING (gate) GROUP BY file_id, lg.gate"


def sample_readout(spark, sf_dir):
    """The same pooled over the files of a sample."""
    return _nested_readout(spark, sf_dir, "sample", pooled=True)


def control_table(spark, sf_dir):
    ev = staged(_singlets(spark, sf_dir).select("role", "igg", "t", "edge", "singlet"), "gated")
    out = readouts.control_stats(gates.explode_gates(ev, _nested()), "gate", "role", "igg", "t")
    return _rounded(out, "nc_median_raw", "nc_median_t", "pc_median_raw", "pc_median_t", "cutoff")


def edge_counts(spark, sf_dir):
    g = _gated(spark, sf_dir)
    return g.groupBy("file_id", "role").agg(F.count("*").alias("n"), F.count_if("edge").alias("n_edge"), F.round(F.avg(F.col("edge").cast("int")), R).alias("keep"))


def singlet_counts(spark, sf_dir):
    return _singlets(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("n"), F.count_if("singlet").alias("n_singlet"), F.count_if(F.col("edge") & F.col("singlet")).alias("n_qc"))


def lymph_rails(spark, sf_dir):
    g = gates.lymphocyte_rails(_gated(spark, sf_dir), "file_id", F.col("edge"), "fsc_a", "ssc_a")
    return g.groupBy("file_id").agg(F.count_if("edge").alias("n_qc"), F.count_if("lymph").alias("n_lymph"))


def _masks_by_file(rows: DataFrame, *masks: str) -> DataFrame:
    """Events and masked events of a file, with digests of their keys (sums of hashes, so that order doesn't matter)."""
    key = F.crc32(F.concat_ws("|", "l_orderkey", "l_linenumber").cast("binary"))
    return rows.groupBy("file_id").agg(F.count("*").alias("n"), *[a for m in masks for a in (F.count_if(m).alias(f"n_{m}"), F.sum(F.when(F.col(m), key)).alias(f"keys_{m}"))])


def singlets_mixture(spark, sf_dir):
    return _masks_by_file(mixture_gates.singlets_mixture(_gated(spark, sf_dir), "file_id", KEY, "fsc_a", "fsc_h"), "singlet")


def singlets_hybrid(spark, sf_dir):
    return _masks_by_file(mixture_gates.singlets_hybrid(_gated(spark, sf_dir), "file_id", KEY, "fsc_a", "fsc_h"), "singlet")


def lymph_guide(spark, sf_dir):
    """Lymphocytes among edge-gated events; files of the proxy tables hold some 600 events, so the least guide is 200."""
    rows = _gated(spark, sf_dir)
    guide = gates.marker_positive(F.col("cd3"), 150.0, 1.0) | gates.marker_positive(F.col("cd19"), 150.0, 1.0)
    cfg = mixture_gates.GuideConfig(min_guide=200, min_low_fit=200)
    return _masks_by_file(mixture_gates.lymphocytes_guided(rows, "file_id", KEY, F.col("edge"), guide, "fsc_a", "ssc_a", cfg=cfg), "edge", "lymph")


def mad_per_file(spark, sf_dir):
    ev = events(spark, sf_dir)
    return _rounded(statistics.with_mad(ev, ["file_id"], "igg"), "med", "mad")


def robust_z_summary(spark, sf_dir):
    z = statistics.robust_z(events(spark, sf_dir), ["file_id"], "ssc_a", "z")
    return z.groupBy("file_id").agg(F.round(F.min("z"), R).alias("lo"), F.round(F.max("z"), R).alias("hi"), F.round(F.avg("z"), R).alias("mean_z"))


def weighted_background(spark, sf_dir):
    ev = events(spark, sf_dir)
    return _rounded(statistics.weighted_quantile(ev, ["role"], "igg", "cd3", 0.99, "x_bg"), "x_bg")


def igg_histogram(spark, sf_dir):
    g = _gated(spark, sf_dir).where("edge")
    h = statistics.histogram(g, ["role"], "t", 256)
    h = h.withColumn("smooth", statistics.smoothed(F.col("n"), ["role"]))
    return h.select("role", "bin", "n", F.round("smooth", R).alias("smooth"), F.round(F.col("lo") + (F.col("bin") + 0.5) * F.col("width"), R).alias("centre"))


def igg_peak(spark, sf_dir):
    h = statistics.histogram(_gated(spark, sf_dir).where("edge"), ["role"], "t", 64).withColumn("s", statistics.smoothed(F.col("n"), ["role"]))
    first = Window.partitionBy("role").orderBy(F.desc("s"), "bin")
    return h.withColumn("r", F.row_number().over(first)).where("r = 1").select("role", F.col("bin").alias("peak_bin"), F.round("s", R).alias("peak"))


def marker_counts(spark, sf_dir):
    ev = _gated(spark, sf_dir)
    pos = {m: gates.marker_positive(F.col(m), 150.0, 1.0) for m in ("cd3", "cd19")}
    return ev.where("edge").groupBy("file_id").agg(*[F.count_if(p).alias(f"n_{m}") for m, p in pos.items()], F.count_if(pos["cd3"] & pos["cd19"]).alias("n_both"))


def transforms(spark, sf_dir):
    ev = events(spark, sf_dir)
    t = N.asinh_t(F.col("igg"), 150.0)
    return ev.select(
        "l_orderkey", "l_linenumber", F.round(t, R).alias("t"), F.round(N.sinh_inverse(t, F.lit(150.0)), 8).alias("back"), F.round(N.log1p_clipped(F.col("cd3") - 100), R).alias("log_cd3"),
        F.round(gates.clip_range(F.col("fsc_a"), 50000.0), R).alias("clipped"), F.round(F.pow(F.lit(10.0), 4 * F.col("ssc_a") / 100000) * 1.0, R).alias("decade"),
    )


def compensation(spark, sf_dir):
    ev = events(spark, sf_dir)
    spill = [[1.0, 0.2], [0.1, 1.0]]
    out = sampling.compensate(ev, ["cd3", "cd19"], spill)
    return out.groupBy("file_id").agg(F.round(F.avg("cd3"), R).alias("cd3"), F.round(F.avg("cd19"), R).alias("cd19"))


def decompensation(spark, sf_dir):
    ev = events(spark, sf_dir)
    out = sampling.decompensate(ev, ["cd3", "cd19"], [[1.0, 0.2], [0.1, 1.0]])
    return out.groupBy("file_id").agg(F.round(F.avg("cd3"), R).alias("cd3"), F.round(F.avg("cd19"), R).alias("cd19"))


def outlier_rejection(spark, sf_dir):
    ev = events(spark, sf_dir)
    limits = gates.outlier_threshold(ev, ["role"], "igg", 0.99)
    return ev.join(F.broadcast(limits), "role").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("igg") > F.col("threshold")).alias("n_out"), F.round(F.first("threshold"), R).alias("threshold"))


def gate_long(spark, sf_dir):
    g = _gated(spark, sf_dir)
    long = gates.explode_gates(g, {"All": F.lit(True), "Edge": F.col("edge"), "CD3+": F.col("edge") & gates.marker_positive(F.col("cd3"), 150.0, 1.0)})
    return long.groupBy("file_id", "gate").agg(F.count("*").alias("n"), F.round(A.median(F.col("igg")), R).alias("mfi"))


def mfi_triplet(spark, sf_dir):
    found = statistics.exact_quantiles(events(spark, sf_dir), ["role"], "igg", [0.5])
    return found.agg(*[F.round(F.max(F.when(F.col("role") == r, F.col("x"))), R).alias(r.lower()) for r in ("NC", "PC", "SAMPLE")])


def score_verdicts(spark, sf_dir):
    per_file = events(spark, sf_dir).groupBy("file_id").agg((100.0 * F.count_if(F.col("igg") > 900) / F.count("*")).alias("pct"), A.median(F.col("igg")).alias("m"))
    ratio = F.col("m") / 300.0
    return per_file.select("file_id", F.round("pct", R).alias("pct"), N.rule_of(F.col("pct")).score.alias("score"), N.rule_of(F.col("pct")).verdict.alias("verdict"), N.rule_of(ratio, N.RATIO_RULES).score.alias("ratio_score"))


def evenly_spaced(spark, sf_dir):
    return sampling.evenly_spaced(events(spark, sf_dir), ["file_id"], ["l_orderkey", "l_linenumber"], 20).select("file_id", "l_orderkey", "l_linenumber")


def hashed_sample(spark, sf_dir):
    return sampling.sample_per_group(events(spark, sf_dir).select("file_id", "l_orderkey", "l_linenumber"), ["file_id"], ["l_orderkey", "l_linenumber"], 25)


def tail_reservoir(spark, sf_dir):
    s = sampling.tail_and_sample(events(spark, sf_dir), ["file_id"], ["l_orderkey", "l_linenumber"], "igg", 0.99, 30)
    return s.select("file_id", "l_orderkey", "l_linenumber", "in_tail")


def pooled_cap(spark, sf_dir):
    s = sampling.pool(events(spark, sf_dir).select("file_id", "l_orderkey", "l_linenumber"), "file_id", ["l_orderkey", "l_linenumber"], per_group=50, total=2000)
    return s.select("file_id", "l_orderkey", "l_linenumber")


def majority_gate(spark, sf_dir):
    """Wide report rows: one column per gate."""
    g = gate_long(spark, sf_dir)
    return g.groupBy("file_id").pivot("gate", ["All", "Edge", "CD3+"]).agg(F.first("n")).select("file_id", F.col("All").alias("n_all"), F.col("Edge").alias("n_edge"), F.col("CD3+").alias("n_cd3"))


_HIST = f"""WITH {EVENTS}, u AS (SELECT role, t FROM edge WHERE edge), rg0 AS (SELECT role, quantile_cont(t, 0.001) AS a, quantile_cont(t, 0.999) AS b FROM u GROUP BY role
), rg AS (SELECT role, a - 0.02 * (b - a) AS lo, ((b + 0.02 * (b - a)) - (a - 0.02 * (b - a))) / @N AS w, b + 0.02 * (b - a) AS hi FROM rg0
), hb AS (SELECT u.role, CAST(least(floor((t - lo) / w), @N - 1) AS INTEGER) AS bin, count(*) AS n FROM u JOIN rg USING (role) WHERE t >= lo AND t <= hi GROUP BY 1, 2
), gr AS (SELECT rg.role, lo, w, b.bin, coalesce(n, 0) AS n FROM rg CROSS JOIN (SELECT CAST(unnest(range(@N)) AS INTEGER) AS bin) b LEFT JOIN hb ON hb.role = rg.role AND hb.bin = b.bin
), sm AS (SELECT *, sum(n) OVER (PARTITION BY role ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE AS s FROM gr)"""

_DRAWN = "md5('0|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"

QUERIES = {
    "fcxm_population_readout": (population_readout, POPULATION_SQL),
    "fcxm_sample_readout": (sample_readout, f"{_LONG}, {_CUTOFF} SELECT sample, lg.gate AS gate, {_READ} FROM lg JOIN cu USING (gate) JOIN ct USING (gate) GROUP BY sample, lg.gate"),
    "fcxm_control_stats": (control_table, f"{_LONG}, {_CUTOFF} SELECT gate, round(nc, 6) AS nc_median_raw, round(nc_t, 6) AS nc_median_t, round(pc, 6) AS pc_median_raw, round(pc_t, 6) AS pc_median_t, n_nc, n_pc, round(cutoff, 6) AS cutoff FROM ct JOIN cu USING (gate)"),
    "gate_edge": (edge_counts, f"WITH {EVENTS} SELECT file_id, role, count(*) AS n, count(*) FILTER (edge) AS n_edge, round(avg(edge::INT), 6) AS keep FROM edge GROUP BY file_id, role"),
    "gate_singlets_mad": (singlet_counts, f"WITH {EVENTS}, {SINGLETS} SELECT file_id, count(*) AS n, count(*) FILTER (singlet) AS n_singlet, count(*) FILTER (edge AND singlet) AS n_qc FROM sing GROUP BY file_id"),
    "gate_singlets_mixture": (singlets_mixture, None),
    "gate_singlets_hybrid": (singlets_hybrid, None),
    "gate_lymph_guide": (lymph_guide, None),
    "gate_lymph_rails": (lymph_rails, f"WITH {EVENTS}, rl AS (SELECT file_id, quantile_cont(fsc_a, 0.10) AS lo, quantile_cont(ssc_a, 0.99) AS hi FROM edge WHERE edge GROUP BY file_id) SELECT file_id, count(*) FILTER (edge) AS n_qc, count(*) FILTER (edge AND fsc_a >= lo AND ssc_a <= hi) AS n_lymph FROM edge LEFT JOIN rl USING (file_id) GROUP BY file_id"),
    "agg_mad": (mad_per_file, f"WITH {EVENTS}, m AS (SELECT file_id, median(igg) AS med FROM ev GROUP BY file_id) SELECT file_id, round(first(med), 6) AS med, round(median(abs(igg - med)), 6) AS mad FROM ev JOIN m USING (file_id) GROUP BY file_id"),
    "prj_robust_z": (robust_z_summary, f"WITH {EVENTS}, m AS (SELECT file_id, median(ssc_a) AS med FROM ev GROUP BY file_id), d AS (SELECT file_id, first(med) AS med, median(abs(ssc_a - med)) AS mad FROM ev JOIN m USING (file_id) GROUP BY file_id), z AS (SELECT file_id, greatest(-8.0, least(8.0, (ssc_a - med) / greatest(mad, 1e-6))) AS z FROM ev JOIN d USING (file_id)) SELECT file_id, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean_z FROM z GROUP BY file_id"),
    "agg_weighted_quantile": (weighted_background, f"WITH {EVENTS}, x AS (SELECT role, igg, sum(cd3) AS w FROM ev WHERE cd3 > 0 GROUP BY role, igg), c AS (SELECT role, igg, sum(w) OVER (PARTITION BY role ORDER BY igg) AS cw, sum(w) OVER (PARTITION BY role) AS tot FROM x) SELECT role, round(min(igg) FILTER (cw >= 0.99 * tot), 6) AS x_bg FROM c GROUP BY role"),
    "agg_histogram": (igg_histogram, _HIST.replace("@N", "256") + " SELECT role, bin, CAST(n AS BIGINT) AS n, round(s, 6) AS smooth, round(lo + (bin + 0.5) * w, 6) AS centre FROM sm"),
    "win_histogram_peak": (igg_peak, _HIST.replace("@N", "64") + " SELECT role, bin AS peak_bin, round(s, 6) AS peak FROM sm QUALIFY row_number() OVER (PARTITION BY role ORDER BY s DESC, bin) = 1"),
    "gate_markers": (marker_counts, f"WITH {EVENTS} SELECT file_id, count(*) FILTER (asinh(cd3 / 150.0) > 1.0) AS n_cd3, count(*) FILTER (asinh(cd19 / 150.0) > 1.0) AS n_cd19, count(*) FILTER (asinh(cd3 / 150.0) > 1.0 AND asinh(cd19 / 150.0) > 1.0) AS n_both FROM edge WHERE edge GROUP BY file_id"),
    "prj_transforms": (transforms, f"WITH {EVENTS} SELECT l_orderkey, l_linenumber, round(asinh(igg / 150.0), 6) AS t, round((exp(asinh(igg / 150.0)) - exp(-asinh(igg / 150.0))) / 2 * 150.0, 8) AS back, round(ln(1 + greatest(cd3 - 100, 0.0)), 6) AS log_cd3, round(least(fsc_a, 50000.0), 6) AS clipped, round(pow(10.0, 4 * ssc_a / 100000), 6) AS decade FROM ev"),
    "prj_compensation": (compensation, f"WITH {EVENTS} SELECT file_id, round(avg(cd3 * (1 / 0.98) + cd19 * (-0.1 / 0.98)), 6) AS cd3, round(avg(cd3 * (-0.2 / 0.98) + cd19 * (1 / 0.98)), 6) AS cd19 FROM ev GROUP BY file_id"),
    "prj_decompensation": (decompensation, f"WITH {EVENTS} SELECT file_id, round(avg(cd3 + cd19 * 0.1), 6) AS cd3, round(avg(cd3 * 0.2 + cd19), 6) AS cd19 FROM ev GROUP BY file_id"),
    "flt_outliers": (outlier_rejection, f"WITH {EVENTS}, q AS (SELECT role, quantile_cont(igg, 0.99) AS th FROM ev GROUP BY role) SELECT ev.role AS role, count(*) AS n, count(*) FILTER (igg > th) AS n_out, round(first(th), 6) AS threshold FROM ev JOIN q USING (role) GROUP BY ev.role"),
    "flt_gate_long": (gate_long, f"WITH {EVENTS}, lg AS (SELECT file_id, igg, 'All' AS gate FROM edge UNION ALL SELECT file_id, igg, 'Edge' FROM edge WHERE edge UNION ALL SELECT file_id, igg, 'CD3+' FROM edge WHERE edge AND asinh(cd3 / 150.0) > 1.0) SELECT file_id, gate, count(*) AS n, round(median(igg), 6) AS mfi FROM lg GROUP BY file_id, gate"),
    "agg_mfi_triplet": (mfi_triplet, f"WITH {EVENTS} SELECT round(median(igg) FILTER (role = 'NC'), 6) AS nc, round(median(igg) FILTER (role = 'PC'), 6) AS pc, round(median(igg) FILTER (role = 'SAMPLE'), 6) AS sample FROM ev"),
    "prj_score_rules": (score_verdicts, f"WITH {EVENTS}, p AS (SELECT file_id, 100.0::DOUBLE * count(*) FILTER (igg > 900) / count(*) AS pct, median(igg) / 300.0 AS ratio FROM ev GROUP BY file_id) SELECT file_id, round(pct, 6) AS pct, CASE WHEN pct >= 60 THEN 3 WHEN pct >= 20 THEN 2 WHEN pct >= 5 THEN 1 ELSE 0 END AS score, CASE WHEN pct >= 60 THEN 'Strong' WHEN pct >= 20 THEN 'Moderate' WHEN pct >= 5 THEN 'Low' ELSE 'Negative' END AS verdict, CASE WHEN ratio >= 6 THEN 3 WHEN ratio >= 4 THEN 2 WHEN ratio >= 2 THEN 1 ELSE 0 END AS ratio_score FROM p"),
    "prj_evenly_spaced": (evenly_spaced, f"WITH {EVENTS}, r AS (SELECT file_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM ev) SELECT file_id, l_orderkey, l_linenumber FROM r WHERE n <= 20 OR i IN (SELECT CAST(floor(k * (n - 1) / 19.0::DOUBLE) AS BIGINT) FROM range(20) t(k))"),
    "srt_sample_per_file": (hashed_sample, f"WITH {EVENTS} SELECT file_id, l_orderkey, l_linenumber FROM ev QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_DRAWN}, l_orderkey, l_linenumber) <= 25"),
    "win_tail_reservoir": (tail_reservoir, f"""WITH {EVENTS}, q AS (SELECT file_id, quantile_cont(igg, 0.99) AS th FROM ev GROUP BY file_id), c AS (SELECT ev.file_id, l_orderkey, l_linenumber, igg >= th AS in_tail FROM ev JOIN q USING (file_id))
SELECT file_id, l_orderkey, l_linenumber, in_tail FROM c QUALIFY in_tail OR row_number() OVER (PARTITION BY file_id, in_tail ORDER BY {_DRAWN}, l_orderkey, l_linenumber) <= 30"""),
    "srt_pool_cap": (pooled_cap, f"""WITH {EVENTS}, s AS (SELECT file_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY file_id ORDER BY {_DRAWN}, l_orderkey, l_linenumber) AS r FROM ev),
c AS (SELECT file_id, least(count(*), 50) AS n FROM ev GROUP BY file_id), a AS (SELECT file_id, 2000 - (sum(n) OVER (ORDER BY file_id) - n) AS room FROM c)
SELECT file_id, l_orderkey, l_linenumber FROM s JOIN a USING (file_id) WHERE r <= 50 AND r <= room"""),
    "rpt_gate_matrix": (majority_gate, f"WITH {EVENTS} SELECT file_id, count(*) AS n_all, nullif(count(*) FILTER (edge), 0) AS n_edge, nullif(count(*) FILTER (edge AND asinh(cd3 / 150.0) > 1.0), 0) AS n_cd3 FROM edge GROUP BY file_id"),
}
