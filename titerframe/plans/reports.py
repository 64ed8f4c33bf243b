"""Queries of report and validation views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement as G
from ..operators import assay, reports, rois, spatial, statistics
from .cdc import _LAB, _SCORE, P, _called, _wells
from .flow import _DRAWN, _HIST, _gated
from .pixels import IMG, _pixels, _px
from .proxies import EVENTS, LAYOUT, events, layout, table
from .proxies import rois as roi_table
from .validation import _RUNS, _runs

ROW = ["l_orderkey", "l_linenumber"]
ALIASES = {"frac_pos": ("fracPos", "fraction_positive", "pos frac"), "median_ratio": ("mfi-ratio", "ratio"), "median_shift": ("shift",)}


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _spills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spillover text per region: its nations as channels, ones on the diagonal, shares by key elsewhere."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))  # a region's nations
    names, keys = F.transform("a", lambda x: x["n_name"]), F.transform("a", lambda x: x["n_nationkey"])
    cell = lambda i, j: F.when(i == j, F.lit("1")).otherwise(F.concat(F.lit("0."), F.lpad(((i * 7 + j * 3) % 100).cast("string"), 2, "0")))
    values = F.flatten(F.transform(keys, lambda i: F.transform(keys, lambda j: cell(i, j))))
    return n.select("n_regionkey", F.concat_ws(",", F.size("a").cast("string"), names, values).alias("text"))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.spill_rows(_spills(spark, sf_dir), ["n_regionkey"], "text")


def plot_points(spark, sf_dir):
    p = reports.plot_points(_gated(spark, sf_dir), ["file_id"], ROW, "fsc_a", "ssc_a", F.col("edge"), 25)
    one = lambda x: F.concat_ws(",", F.round(x["x"], 2).cast("decimal(20,2)").cast("string"), F.round(x["y"], 2).cast("decimal(20,2)").cast("string"), x["inside"].cast("string"))
    return p.select("file_id", F.array_join(F.transform("points", one), ";").alias("points"))


def labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("marker"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("population"), F.col("p_size").alias("panel"))
    return reports.display_labels(p, ["panel"], "marker", "population", "id").select("id", "label")


def axes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    marker = F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))
    return p.select("p_partkey", reports.axis_label(name, marker).alias("label"))


def options(spark, sf_dir):
    return reports.gate_options(_gated(spark, sf_dir), ["file_id"], {"edge": F.col("edge"), "bright": F.col("igg") > 2500, "none": F.lit(False)})


def flat_meta(spark, sf_dir):
    o = table(spark, sf_dir, "supplier")
    meta = F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.struct(F.col("s_suppkey").alias("key"), F.lit("x").alias("kind")).alias("param")))
    return reports.flat_meta(o.select("s_suppkey", meta.alias("meta")), ["s_suppkey"], "meta")


def fallback_masks(spark, sf_dir):
    g = _gated(spark, sf_dir)
    masks = {"T": F.col("edge") & (F.col("cd3") > 100), "lymph": F.col("edge")}
    checked = reports.assert_subset(g, masks["T"], masks["lymph"], "marker mask outside the lymphocytes")
    return checked.groupBy("file_id").agg(F.count_if(reports.mask_of(masks, "CD3+", "T", "lymph")).alias("n_gate"), F.count_if(reports.mask_of(masks, "CD8+", "B", "lymph")).alias("n_fallback"))


def role_curves(spark, sf_dir):
    h = statistics.histogram(_gated(spark, sf_dir).where("edge"), ["role"], "t", 64)
    c = reports.curves(h, [], "role")
    return c.select("role", F.posexplode(F.arrays_zip("x", "density")).alias("bin", "p")).select("role", "bin", F.round("p.x", 6).alias("x"), F.round("p.density", 6).alias("density"))


def strategy(spark, sf_dir):
    """Projections of a page: per file the share of every step of the gating hierarchy, in its parent."""
    g = _gated(spark, sf_dir)
    n, e, t = F.count("*"), F.count_if("edge"), F.count_if(F.col("edge") & (F.col("cd3") > 100))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("gate"), a.alias("n"), (a / F.when(b > 0, b)).alias("of_parent")) for i, (s, a, b) in enumerate((("All", n, n), ("Edge", e, n), ("CD3+", t, e)))])
    return _r(g.groupBy("file_id").agg(steps.alias("s")).select("file_id", F.inline("s")), "of_parent")


def training_pool(spark, sf_dir):
    return reports.training_pool(_gated(spark, sf_dir), "file_id", ROW, F.col("edge"), ["cd3", "igg"], 40, tail=5, least=50).select("file_id", *ROW).distinct()


def bootstrap(spark, sf_dir):
    s = reports.sample_with_replacement(events(spark, sf_dir).select("file_id", *ROW), ["file_id"], ROW, 20)
    return s.select("file_id", "draw", *ROW)


def numbered(spark, sf_dir):
    return reports.running_count(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "i")


def qc_summary(spark, sf_dir):
    s = reports.qc_summary(_wells(spark, sf_dir), P, min_rois=60)
    return _r(s, "mean_n_rois", "mean_uncertain_fraction").withColumns({c: F.array_join(c, ",") for c in ("low_roi_wells", "high_uncertain_wells")}).withColumn("warnings", F.array_join("warnings", " "))


def runtime(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumns({"fit_s": F.col("n") / 100.0, "predict_s": F.col("tp") / 10.0})
    return _r(reports.runtime_breakdown(runs, G.best_settings(runs, "algorithm", "params", "f1"), "algorithm", "params", ["fit_s", "predict_s"]), "fit_s", "predict_s")


def prefixed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("mask_chars"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") * 1.5).alias("energy_x"), F.col("n_chars").alias("other"))
    return _r(reports.prefixed_means(d, ["lang"]), "mean", "sd")


def simulated(spark, sf_dir):
    meta = F.to_json(F.struct(F.struct(F.col("p_size").alias("n_cells"), (F.col("p_retailprice") / 100).alias("noise")).alias("sim_kwargs")))
    s = reports.simulation_parameters(table(spark, sf_dir, "part").select("p_partkey", meta.alias("meta")), ["p_partkey"], "meta", "n_cells int, noise double", dataset_type="train")
    return _r(s, "noise")


def disagreements(spark, sf_dir):
    """Orders of one customer and priority are votes on the customer's case."""
    score = F.element_at(F.array(*[F.lit(v) for v in (2, 4, 2, 6, 4, 7)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    votes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("annotator"), score.alias("score"))
    return reports.disagreements(votes, ["case"], "annotator", "score", 3)


def excluded(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reports.without(o, gone, ["o_custkey"])


def regions(spark, sf_dir):
    return reports.evaluation_region(_pixels(spark, sf_dir), IMG, 2, 40, 40)


def circles(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("image"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_partkey") % 60 - 10).cast("string").alias("roi_x_px"), (F.col("l_suppkey") % 60 - 10).cast("string").alias("roi_y_px"), F.lit("8").alias("diameter_px"))
    s = s.withColumns({"center_x_px": F.col("roi_x_px").cast("double") + 4, "center_y_px": F.col("roi_y_px").cast("double") + 4})
    return reports.clean_circles(s, IMG, "id", 40, 40).select("image", "id", "roi_x_px", "roi_y_px")


def instances(spark, sf_dir):
    s = reports.instance_scores(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 1), IMG, thresholds=(0.51, 0.6, 0.7))
    return _r(s, "precision", "recall", "f1", "mean_iou", "pq")


def split_merge(spark, sf_dir):
    return reports.splits_and_merges(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)


def greedy_total(spark, sf_dir):
    """Matched pairs of region overlaps: a region's best partner at an IoU over one half is its only one."""
    m = spatial.match_pairs(spatial.overlaps(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 1), IMG), IMG, "t", "p", "iou", 0.501)
    return m.groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("total"))


def scored(spark, sf_dir):
    return _r(rois.score_rois(roi_table(spark, sf_dir), P, 60).select("plate", "well", "role", "n_rois", "frac_pos_raw", "corrected", "score", "adjusted_score"), "frac_pos_raw", "corrected")


def reasons(spark, sf_dir):
    k = F.col("roi_id")
    r = roi_table(spark, sf_dir).select("plate", (k % 17 == 0).alias("violating"), (k % 13 == 0).alias("border"), (k % 3).alias("degree"), "area", ((k % 100 - 50) / 11.0).alias("area_z"), (k % 10 / 10.0).alias("circularity"), (k % 7 / 7.0).alias("solidity"), (k % 101 / 101.0).alias("eccentricity"), F.when(k % 5 != 0, k % 29 / 29.0).alias("gap"))
    return rois.shape_reasons(r, min_area=25).groupBy("plate", F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("n"), F.count_if("excluded").alias("n_excluded"))


def tubes(spark, sf_dir):
    k = F.col("s_suppkey")
    meta = F.create_map(F.when(k % 3 == 0, "TUBE_NAME").otherwise("Other"), F.concat(F.lit("t"), k.cast("string")), F.when(k % 2 == 0, "$SRC").otherwise("Sample-Name"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("s"), k.cast("string"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.tube_name(meta, F.lit("unnamed")).alias("tube"))


def marker_labels(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.concat_ws(" ", F.lit("CD3"), F.when(k % 3 == 0, "PerCP-A+").otherwise("PerCP-A-"), F.lit("CD19"), F.when(k % 2 == 0, "APC-A+").otherwise("APC-A-"))
    return table(spark, sf_dir, "part").select("p_partkey", T.positive_marker(label).alias("marker"))


def metric_names(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "fracPos").when(k == 1, "MFI Ratio").when(k == 2, " pos-frac").when(k == 3, "Shift").when(k == 4, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_metric(name, ALIASES).alias("metric"))


def renamed_texts(spark, sf_dir):
    return reports.rewritten(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name"], {"UNITED": "A", "UNITED STATES": "B", "IN": "C"})


def top_by_plate(spark, sf_dir):
    """The report's list of every plate."""
    e = assay.allele_evidence(layout(spark, sf_dir), _called(spark, sf_dir).where("role = 'sample'"), P)
    return assay.top_alleles_by(e, P).select("plate", "locus", "allele", "total", "n_pos", F.round("fraction", 6).alias("fraction"), "ratio")


_PAIRS = f"""WITH {_px('a')}, {_px('b', 1)}, {_px('c', 3)}, ta AS (SELECT image, label, count(*) AS ar FROM a WHERE label > 0 GROUP BY 1, 2), pb AS (SELECT image, label, count(*) AS ar FROM b WHERE label > 0 GROUP BY 1, 2), pc AS (SELECT image, label, count(*) AS ar FROM c WHERE label > 0 GROUP BY 1, 2),
io AS (SELECT a.image, a.label AS t, b.label AS p, count(*) AS i, first(ta.ar) AS ta, first(pb.ar) AS pa FROM a JOIN b USING (image, y, x) JOIN ta ON ta.image = a.image AND ta.label = a.label JOIN pb ON pb.image = a.image AND pb.label = b.label WHERE a.label > 0 AND b.label > 0 GROUP BY 1, 2, 3),
ic AS (SELECT a.image, a.label AS t, c.label AS p, count(*) AS i, first(ta.ar) AS ta, first(pc.ar) AS pa FROM a JOIN c USING (image, y, x) JOIN ta ON ta.image = a.image AND ta.label = a.label JOIN pc ON pc.image = a.image AND pc.label = c.label WHERE a.label > 0 AND c.label > 0 GROUP BY 1, 2, 3)"""
_PART = "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END"
QUERIES = {
    "prj_matrix_rows": (matrix_rows, "SELECT a.n_regionkey AS n_regionkey, a.n_name AS \"row\", b.n_name AS \"column\", CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0::DOUBLE ELSE ((a.n_nationkey * 7 + b.n_nationkey * 3) % 100) / 100.0::DOUBLE END AS value FROM nation a JOIN nation b USING (n_regionkey)"),
    "prj_plot_points": (plot_points, f"""WITH {EVENTS}, s AS (SELECT file_id, l_orderkey, l_linenumber, fsc_a, ssc_a, edge FROM edge QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_DRAWN}, l_orderkey, l_linenumber) <= 25)
SELECT file_id, string_agg(CAST(CAST(round(fsc_a, 2) AS DECIMAL(20, 2)) AS VARCHAR) || ',' || CAST(CAST(round(ssc_a, 2) AS DECIMAL(20, 2)) AS VARCHAR) || ',' || CAST(edge AS VARCHAR), ';' ORDER BY l_orderkey, l_linenumber, fsc_a, ssc_a) AS points FROM s GROUP BY file_id"""),
    "prj_display_labels": (labels, "WITH p AS (SELECT p_partkey AS id, p_brand AS marker, p_size AS panel, CASE WHEN p_partkey % 5 = 0 OR p_type = '' THEN p_brand ELSE p_type END AS own FROM part) SELECT id, CASE WHEN row_number() OVER (PARTITION BY panel, own ORDER BY id) > 1 THEN own || ' (' || marker || ')' ELSE own END AS label FROM p"),
    "prj_axis_labels": (axes, f"WITH p AS (SELECT p_partkey, {_PART} AS l, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END AS m FROM part) SELECT p_partkey, CASE WHEN m = '' THEN CASE WHEN l <> '' THEN l || ' marker' ELSE 'marker' END WHEN l = '' OR l = m THEN m ELSE m || ' (' || l || ')' END AS label FROM p"),
    "prj_gate_options": (options, f"WITH {EVENTS}, c AS (SELECT file_id, count(*) FILTER (edge) AS e, count(*) FILTER (igg > 2500) AS b FROM edge GROUP BY 1) SELECT file_id, 0 AS ord, 'edge' AS gate, e AS n FROM c WHERE e > 0 UNION ALL SELECT file_id, 1, 'bright', b FROM c WHERE b > 0"),
    "prj_flat_meta": (flat_meta, "SELECT s_suppkey, 'meta__nation' AS name, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT s_suppkey, 'meta__param__key', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, 'meta__param__kind', 'x' FROM supplier"),
    "flt_fallback_masks": (fallback_masks, f"WITH {EVENTS} SELECT file_id, count(*) FILTER (edge AND cd3 > 100) AS n_gate, count(*) FILTER (edge) AS n_fallback FROM edge GROUP BY file_id"),
    "rpt_curves": (role_curves, _HIST.replace("@N", "64") + " SELECT role, bin, round(lo + (bin + 0.5) * w, 6) AS x, round(n / sum(n) OVER (PARTITION BY role), 6) AS density FROM sm"),
    "rpt_gating_strategy": (strategy, f"WITH {EVENTS}, c AS (SELECT file_id, count(*) AS n, count(*) FILTER (edge) AS e, count(*) FILTER (edge AND cd3 > 100) AS t FROM edge GROUP BY 1) SELECT file_id, 0 AS step, 'All' AS gate, n, 1.0::DOUBLE AS of_parent FROM c UNION ALL SELECT file_id, 1, 'Edge', e, round(e / n, 6) FROM c UNION ALL SELECT file_id, 2, 'CD3+', t, round(t / nullif(e, 0), 6) FROM c"),
    "srt_training_pool": (training_pool, f"""WITH {EVENTS}, i AS (SELECT file_id, l_orderkey, l_linenumber, cd3, igg FROM edge WHERE edge), q AS (SELECT file_id, count(*) AS n, quantile_cont(cd3, 0.99) AS a, quantile_cont(igg, 0.99) AS b FROM i GROUP BY 1)
SELECT file_id, l_orderkey, l_linenumber FROM i QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_DRAWN}, l_orderkey, l_linenumber) <= 40
UNION SELECT i.file_id, l_orderkey, l_linenumber FROM i JOIN q USING (file_id) WHERE n >= 50 AND cd3 >= a QUALIFY row_number() OVER (PARTITION BY i.file_id ORDER BY {_DRAWN.replace("0|", "1|")}, l_orderkey, l_linenumber) <= 5
UNION SELECT i.file_id, l_orderkey, l_linenumber FROM i JOIN q USING (file_id) WHERE n >= 50 AND igg >= b QUALIFY row_number() OVER (PARTITION BY i.file_id ORDER BY {_DRAWN.replace("0|", "2|")}, l_orderkey, l_linenumber) <= 5"""),
    "srt_with_replacement": (bootstrap, f"""WITH {EVENTS}, r AS (SELECT file_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM ev),
d AS (SELECT DISTINCT file_id, n, CAST(d AS INTEGER) AS draw FROM r, range(20) t(d)), h AS (SELECT file_id, draw, CAST('0x' || substr(md5('0|' || file_id || '|' || draw), 1, 8) AS BIGINT) % n AS i FROM d)
SELECT file_id, draw, l_orderkey, l_linenumber FROM r JOIN h USING (file_id, i)"""),
    "win_running_count": (numbered, "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS i FROM orders"),
    "agg_qc_summary": (qc_summary, f"""{_LAB}, g AS (SELECT plate, count(*) AS total_wells, coalesce(string_agg(well, ',' ORDER BY well) FILTER (n_rois < 60), '') AS low_roi_wells, coalesce(string_agg(well, ',' ORDER BY well) FILTER (frac_uncertain > 0.25), '') AS high_uncertain_wells, round(avg(n_rois), 6) AS mean_n_rois, round(avg(frac_uncertain), 6) AS mean_uncertain_fraction, count(*) FILTER (n_rois < 60) AS nl, count(*) FILTER (frac_uncertain > 0.25) AS nh FROM wc GROUP BY plate)
SELECT plate, total_wells, low_roi_wells, high_uncertain_wells, mean_n_rois, mean_uncertain_fraction, total_wells - nl AS valid_wells, concat_ws(' ', CASE WHEN nl > 0 THEN nl || ' well(s) have low ROI count.' END, CASE WHEN nh > 0 THEN nh || ' well(s) have high uncertain fraction.' END) AS warnings FROM g"""),
    "agg_runtime_breakdown": (runtime, f"{_RUNS}, bs AS (SELECT algorithm, params FROM wt GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY avg(f1) DESC, params) = 1) SELECT algorithm, params, round(avg(n / 100.0::DOUBLE), 6) AS fit_s, round(avg(tp / 10.0::DOUBLE), 6) AS predict_s FROM wt JOIN bs USING (algorithm, params) GROUP BY 1, 2"),
    "agg_prefixed_means": (prefixed, "SELECT lang, 'mask_chars' AS metric, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY 1 UNION ALL SELECT lang, 'energy_x', round(avg(doc_id * 1.5::DOUBLE) FILTER (doc_id % 7 <> 0), 6), round(stddev_pop(doc_id * 1.5::DOUBLE) FILTER (doc_id % 7 <> 0), 6) FROM documents GROUP BY 1"),
    "agg_simulation_parameters": (simulated, "SELECT p_partkey, CAST(p_size AS INTEGER) AS n_cells, round(p_retailprice / 100, 6) AS noise, 'train' AS dataset_type FROM part"),
    "flt_disagreements": (disagreements, """WITH v AS (SELECT o_custkey AS c, o_orderkey % 3 + 1 AS a, CASE o_orderkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 4 ELSE 7 END AS s FROM orders), o AS (SELECT c, a, count(DISTINCT s) AS k, min(s) AS v FROM v GROUP BY 1, 2),
g AS (SELECT c, count(*) AS n, max(k) AS k, string_agg(a || ':' || v, ';' ORDER BY a) AS votes, count(DISTINCT v) AS nd, count(*) FILTER (v = 7) AS bad, count(*) FILTER (v = 2) AS n2, count(*) FILTER (v = 4) AS n4 FROM o GROUP BY c),
r AS (SELECT *, CASE WHEN n <> 3 OR k <> 1 THEN 'missing_or_conflicting_annotations' WHEN bad > 0 THEN 'invalid_score' END AS reason FROM g)
SELECT c AS "case", votes, reason, CASE WHEN reason IS NULL THEN CAST(nd AS INTEGER) END AS n_distinct, CASE WHEN reason IS NULL THEN CASE WHEN n2 = 2 THEN 2 WHEN n4 = 2 THEN 4 END END AS majority, CASE WHEN reason IS NULL THEN CASE WHEN nd = 3 THEN 'three_way' ELSE 'two_vs_one' END END AS kind
FROM r WHERE reason IS NOT NULL OR (n2 > 0 AND n4 > 0)"""),
    "flt_excluded": (excluded, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "flt_region": (regions, f"WITH {_px('a')} SELECT image, greatest(0, min(y) - 2) AS top, greatest(0, min(x) - 2) AS \"left\", least(40, max(y) + 3) AS bottom, least(40, max(x) + 3) AS \"right\" FROM a WHERE label > 0 GROUP BY image"),
    "val_clean_circles": (circles, "WITH c AS (SELECT l_suppkey % 8 AS image, l_orderkey || '-' || l_linenumber AS id, CAST(l_partkey % 60 - 10 AS DOUBLE) AS x, CAST(l_suppkey % 60 - 10 AS DOUBLE) AS y FROM lineitem) SELECT image, id, x AS roi_x_px, y AS roi_y_px FROM c WHERE NOT (x + 8 <= 0 OR y + 8 <= 0 OR x >= 40 OR y >= 40) QUALIFY row_number() OVER (PARTITION BY image, x, y ORDER BY id) = 1"),
    "val_instance_scores": (instances, f"""{_PAIRS}, n AS (SELECT image, (SELECT count(*) FROM ta WHERE ta.image = m.image) AS n_truth, (SELECT count(*) FROM pb WHERE pb.image = m.image) AS n_predicted FROM (SELECT DISTINCT image FROM a) m), g AS (SELECT n.*, CAST(t AS DOUBLE) AS threshold FROM n, (VALUES (0.51::DOUBLE), (0.6), (0.7)) v(t)),
h AS (SELECT g.*, count(*) FILTER (i / (ta + pa - i) >= threshold) AS tp, coalesce(sum(i / (ta + pa - i)) FILTER (i / (ta + pa - i) >= threshold), 0) AS tot FROM g LEFT JOIN io USING (image) GROUP BY ALL), k AS (SELECT *, n_predicted - tp AS fp, n_truth - tp AS fn FROM h)
SELECT image, threshold, n_truth, n_predicted, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(tot / nullif(tp, 0), 6) AS mean_iou, round(tot / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn), 6) AS pq FROM k"""),
    "val_splits_merges": (split_merge, f"""{_PAIRS}, s AS (SELECT image, count(*) AS n FROM (SELECT image, t FROM ic WHERE i >= 0.1 * ta GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), m AS (SELECT image, count(*) AS n FROM (SELECT image, p FROM ic WHERE i >= 0.1 * pa GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT x.image, coalesce(s.n, 0) AS splits, coalesce(m.n, 0) AS merges FROM (SELECT DISTINCT image FROM ic) x LEFT JOIN s ON s.image = x.image LEFT JOIN m ON m.image = x.image"""),
    "jn_matching_over_half": (greedy_total, f"{_PAIRS} SELECT image, count(*) AS n, round(sum(i / (ta + pa - i)), 6) AS total FROM io WHERE i / (ta + pa - i) >= 0.501 GROUP BY image"),
    "cdc_score_rois": (scored, f"{_LAB}, w60 AS (SELECT plate FROM wf GROUP BY plate HAVING count(DISTINCT well) = 60) SELECT plate, well, role, n_rois, round(frac_pos_raw, 6) AS frac_pos_raw, round(corrected, 6) AS corrected, {_SCORE.format('frac_pos_raw')} AS score, {_SCORE.format('corrected')} AS adjusted_score FROM wc JOIN w60 USING (plate)"),
    "cdc_shape_reasons": (reasons, """WITH r AS (SELECT o_orderpriority AS plate, o_orderkey AS k, o_orderkey % 400 + 20 AS area, o_orderkey % 3 AS dg, abs((o_orderkey % 100 - 50) / 11.0::DOUBLE) AS z FROM orders),
q AS (SELECT plate, concat_ws('+', CASE WHEN k % 17 = 0 THEN 'touching_violation' END, CASE WHEN area < 25 THEN 'too_small' END, CASE WHEN k % 13 = 0 THEN 'border_touch' END, CASE WHEN dg = 0 AND z > 3.5 THEN 'area_outlier' WHEN dg > 0 AND z > 4.5 THEN 'area_outlier_touching' END,
  CASE WHEN k % 10 / 10.0::DOUBLE < 0.4 AND dg > 0 AND k % 7 / 7.0::DOUBLE < 0.8 THEN 'merge_shape' END, CASE WHEN k % 101 / 101.0::DOUBLE > 0.95 AND dg = 0 THEN 'too_elongated' END, CASE WHEN k % 5 <> 0 AND k % 29 / 29.0::DOUBLE < 0.15 THEN 'weak_boundary' END) AS reasons FROM r)
SELECT plate, reasons, count(*) AS n, count(*) FILTER (reasons <> '') AS n_excluded FROM q GROUP BY 1, 2"""),
    "str_tube_names": (tubes, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 't' || s_suppkey WHEN s_suppkey % 5 = 0 THEN 'unnamed' ELSE 's' || s_suppkey END AS tube FROM supplier"),
    "str_positive_marker": (marker_labels, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'CD3' WHEN p_partkey % 2 = 0 THEN 'CD19' END AS marker FROM part"),
    "str_metric_aliases": (metric_names, "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'frac_pos' WHEN 1 THEN 'median_ratio' WHEN 2 THEN 'frac_pos' WHEN 3 THEN 'median_shift' WHEN 4 THEN translate(lower(p_brand), '- ', '__') END AS metric FROM part"),
    "val_rewritten_names": (renamed_texts, "SELECT n_nationkey, replace(replace(replace(n_name, 'UNITED STATES', 'B'), 'UNITED', 'A'), 'IN', 'C') AS n_name FROM nation"),
    "cdc_top_alleles": (top_by_plate, f"""{_LAB}, {LAYOUT}, sw AS (SELECT * FROM ca WHERE role = 'sample'), k AS (SELECT p.plate, lay.* FROM lay CROSS JOIN (SELECT DISTINCT plate FROM sw) p),
e AS (SELECT k.plate AS plate, locus, allele, count(*) AS total, count(*) FILTER (effective_call = 'positive') AS n_pos FROM k LEFT JOIN sw ON sw.plate = k.plate AND sw.well = k.well GROUP BY 1, 2, 3)
SELECT plate, locus, allele, total, n_pos, round(n_pos / total, 6) AS fraction, n_pos || '/' || total AS ratio FROM e QUALIFY row_number() OVER (PARTITION BY plate ORDER BY n_pos / total DESC, n_pos DESC, total DESC, locus, allele) <= 35"""),
}
