"""Validation queries: raters, confusion, agreement, rankings, pivots, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agreement as G
from .proxies import EVENTS, events, table
from .scores import signed_rank_sql

R6 = 6


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R6) for c in cols})


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


_RATED = "WITH ra AS (SELECT doc_id, quality, toxic, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"


def _runs(spark, sf_dir) -> DataFrame:
    """A metrics table: each file's events gated by two 'algorithms' with thresholds as parameters."""
    ev = events(spark, sf_dir)
    runs = spark.createDataFrame([("band", "k=1", 20.0), ("band", "k=2", 30.0), ("cut", "c=25", 25.0), ("cut", "c=35", 35.0)], "algorithm string, params string, th double")
    j = ev.select("file_id", "sample", "ssc_a", "cd19").crossJoin(F.broadcast(runs))  # four settings: a parameter table
    j = j.withColumns({"truth": F.col("ssc_a") > 25000, "pred": F.when(F.col("algorithm") == "band", F.abs(F.col("ssc_a") - 38000) < F.col("th") * 500).otherwise(F.col("ssc_a") > F.col("th") * 1000)})
    return G.weighted_scores(G.confusion(j, ["algorithm", "params", "sample", "file_id"], F.col("truth"), F.col("pred")))


_RUNS = f"""WITH {EVENTS}, st(algorithm, params, th) AS (VALUES ('band', 'k=1', 20.0::DOUBLE), ('band', 'k=2', 30.0), ('cut', 'c=25', 25.0), ('cut', 'c=35', 35.0)),
pr AS (SELECT st.*, file_id, sample, ssc_a > 25000 AS truth, CASE WHEN algorithm = 'band' THEN abs(ssc_a - 38000) < th * 500 ELSE ssc_a > th * 1000 END AS pred FROM ev CROSS JOIN st),
cf AS (SELECT algorithm, params, sample, file_id, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND NOT pred) AS tn, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) AS n FROM pr GROUP BY ALL),
wt AS (SELECT *, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / n AS f1,
  (coalesce(tp / nullif(tp + fp + fn, 0), 0) * (tp + fn) + coalesce(tn / nullif(tn + fp + fn, 0), 0) * (tn + fp)) / n AS jaccard FROM cf)"""


def confusion(spark, sf_dir):
    return _r(_runs(spark, sf_dir), "f1", "jaccard")


def metric_summary(spark, sf_dir):
    return _r(G.metric_summary(_runs(spark, sf_dir), ["algorithm", "params", "sample"], "file_id"), "mean_f1", "std_f1", "mean_jaccard", "std_jaccard")


def best(spark, sf_dir):
    s = G.metric_summary(_runs(spark, sf_dir), ["algorithm", "params", "sample"], "file_id")
    return _r(G.best_settings(s, "algorithm", "params", "mean_f1"), "score")


def best_rows(spark, sf_dir):
    """Long metrics of the best settings only: a semi join."""
    long = _runs(spark, sf_dir)
    b = G.best_settings(long, "algorithm", "params", "f1")
    return _r(long.join(b, ["algorithm", "params"], "left_semi"), "f1", "jaccard").select("algorithm", "params", "file_id", "f1")


def heat_map(spark, sf_dir):
    s = _runs(spark, sf_dir)
    return s.groupBy("algorithm", "params").pivot("sample", list(range(25))).agg(F.round(F.avg("f1"), R6)).select("algorithm", "params", *[F.col(str(i)).alias(f"s{i}") for i in range(25)])


def rater_confusion(spark, sf_dir):
    c = G.confusion(_rated(spark, sf_dir), ["lang"], F.col("quality") == 1, F.col("toxic") == 0)
    return _r(G.weighted_scores(c), "f1", "jaccard")


def rater_crosstab(spark, sf_dir):
    rows = _rated(spark, sf_dir).select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return _r(G.crosstab(rows, "a", "b", [0, 1, 2], normalise=True), "share")


def count_errors(spark, sf_dir):
    rows = _rated(spark, sf_dir).select("lang", (F.col("n_chars") % 97).alias("p"), (F.col("n_chars") % 53).alias("t"))
    return _r(G.count_errors(rows, ["lang"], "p", "t"), "bias", "mae", "rmse", "median_abs", "mean_rel", "pearson", "spearman")


def energy(spark, sf_dir):
    rows = _rated(spark, sf_dir).select("lang", (F.col("n_chars") % 97).alias("p"), (F.col("n_chars") % 53).alias("t"))
    return _r(G.energy_errors(rows, ["lang"], "p", "t", 10.0), "rmse", "mae", "slope", "intercept", "within", "ccc", "wasserstein", "nrmse")


def micro_macro(spark, sf_dir):
    c = _runs(spark, sf_dir)
    return _r(G.micro_macro(c, ["algorithm", "params"]), "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1")


def majority(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return G.majority(d, ["source"], "lang")


def pooled_tiles(spark, sf_dir):
    c = _runs(spark, sf_dir)
    return _r(G.pooled(c, ["algorithm", "sample"], ["tp", "fp", "fn"], {"f1": "n", "jaccard": "n"}), "f1", "jaccard")


def overall(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return _r(G.with_overall(d, "lang", [F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")]), "mean_chars")


def consensus(spark, sf_dir):
    rows = _rated(spark, sf_dir).select("lang", F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"), ((F.col("n_chars") % 7) / 6.0).alias("m"))
    return _r(G.consensus_error(rows, "lang", ("a", "b"), "m"), "pair_error", "human_error", "method_error", "ratio")


def wilcoxon(spark, sf_dir):
    rows = _rated(spark, sf_dir).select("lang", (F.col("n_chars") % 13).cast("double").alias("a"), (F.col("n_chars") % 11).cast("double").alias("b"))
    return _r(G.signed_ranks(rows, ["lang"], "a", "b"), "statistic", "p_value")


def ap(spark, sf_dir):
    rows = _rated(spark, sf_dir).select("lang", "doc_id", (F.col("n_chars") % 101).alias("score"), (F.col("quality") == 1).alias("hit"))
    rows = rows.withColumn("n_truth", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("lang")))
    return _r(G.average_precision(rows, ["lang"], "score", "hit", "n_truth", "doc_id"), "ap")


def full_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sides = {f"n_{lang}": d.where(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias("n")) for lang in ("en", "de", "fr")}
    return G.join_counts(sides, ["source"])


def wide_raters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.min("n_chars"))


def unpivoted(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.unpivot("doc_id", ["quality", "toxic"], "rater", "vote").where("vote IS NOT NULL")


def channel_division(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    n = ev.select("user_id").distinct().agg(F.count("*").alias("files"))
    c = ev.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))  # one row
    return c.select("event_type", "n", (F.col("n") == F.col("files")).alias("everywhere"))


def last_turns(spark, sf_dir):
    """Last-wins state of an append-only history."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("role", F.struct("turn", "role")).alias("last_role"), F.count("*").alias("n_changes"))


def set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.where("lang = 'en'").select("source").distinct(), d.where("n_chars > 9000").select("source").distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("set"), "source")
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))


def unmatched(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def device_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("sd"), F.percentile("p_retailprice", F.lit(0.5)).alias("median"), F.percentile("p_retailprice", F.lit(0.1)).alias("q10"), F.percentile("p_retailprice", F.lit(0.9)).alias("q90"))
    return _r(s.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy())), "mean", "sd", "median", "q10", "q90", "fraction")


def tail_window(spark, sf_dir):
    """The last tenth of every group's epochs."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    e = e.withColumn("epoch", day)
    last, first = F.max("epoch").over(Window.partitionBy("event_type")), F.min("epoch").over(Window.partitionBy("event_type"))
    return e.withColumns({"last": last, "first": first}).where("epoch > last - 0.1 * (last - first)").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), R6).alias("mean_value"))


def running_maximum(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    return q.select("p_size", F.round(F.max("m").over(Window.partitionBy().orderBy("p_size")), R6).alias("level"))


_D = "doc_id"
QUERIES = {
    "val_confusion": (confusion, f"{_RUNS} SELECT algorithm, params, sample, file_id, tp, tn, fp, fn, n, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard FROM wt"),
    "val_metric_summary": (metric_summary, f"{_RUNS} SELECT algorithm, params, sample, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1, round(avg(jaccard), 6) AS mean_jaccard, round(stddev_samp(jaccard), 6) AS std_jaccard, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(DISTINCT file_id) AS n_files FROM wt GROUP BY algorithm, params, sample"),
    "val_best_settings": (best, f"{_RUNS}, s AS (SELECT algorithm, params, sample, avg(f1) AS m FROM wt GROUP BY ALL), b AS (SELECT algorithm, params, avg(m) AS score FROM s GROUP BY ALL) SELECT algorithm, params, round(score, 6) AS score, 1 AS rank FROM b QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY score DESC, params) = 1"),
    "val_best_rows": (best_rows, f"{_RUNS}, a AS (SELECT algorithm, params, avg(f1) AS m FROM wt GROUP BY ALL), b AS (SELECT algorithm, params FROM a QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY m DESC, params) = 1) SELECT algorithm, params, file_id, round(f1, 6) AS f1 FROM wt SEMI JOIN b USING (algorithm, params)"),
    "val_heat_map": (heat_map, f"{_RUNS} SELECT algorithm, params, " + ", ".join(f"round(avg(f1) FILTER (sample = {i}), 6) AS s{i}" for i in range(25)) + " FROM wt GROUP BY algorithm, params"),
    "val_rater_confusion": (rater_confusion, f"{_RATED}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) AS n FROM ra GROUP BY lang) SELECT lang, tp, tn, fp, fn, n, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / n, 6) AS f1, round((coalesce(tp / nullif(tp + fp + fn, 0), 0) * (tp + fn) + coalesce(tn / nullif(tn + fp + fn, 0), 0) * (tn + fp)) / n, 6) AS jaccard FROM c"),
    "val_crosstab": (rater_crosstab, f"{_RATED}, d(v) AS (VALUES (0), (1), (2)), c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM ra GROUP BY ALL), g AS (SELECT x.v AS a, y.v AS b, coalesce(n, 0) AS n FROM d x CROSS JOIN d y LEFT JOIN c ON c.a = x.v AND c.b = y.v) SELECT a, b, n, round(n / nullif(sum(n) OVER (PARTITION BY a), 0), 6) AS share FROM g"),
    "val_count_errors": (count_errors, f"{_RATED}, x AS (SELECT lang, CAST(n_chars % 97 AS DOUBLE) AS p, CAST(n_chars % 53 AS DOUBLE) AS t FROM ra), k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS rp, rank() OVER (PARTITION BY lang ORDER BY t) + (count(*) OVER (PARTITION BY lang, t) - 1) / 2 AS rt FROM x) SELECT lang, count(*) AS n, round(avg(p - t), 6) AS bias, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(median(abs(p - t)), 6) AS median_abs, round(avg(abs(p - t) / nullif(t, 0)), 6) AS mean_rel, round(corr(p, t), 6) AS pearson, round(corr(rp, rt), 6) AS spearman FROM k GROUP BY lang"),
    "val_energy": (energy, f"{_RATED}, x AS (SELECT lang, CAST(n_chars % 97 AS DOUBLE) AS p, CAST(n_chars % 53 AS DOUBLE) AS t FROM ra), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS ip, row_number() OVER (PARTITION BY lang ORDER BY t) AS it FROM x), w AS (SELECT a.lang, avg(abs(a.p - b.t)) AS w1 FROM i a JOIN i b ON a.lang = b.lang AND a.ip = b.it GROUP BY a.lang) SELECT x.lang AS lang, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(regr_slope(p, t), 6) AS slope, round(regr_intercept(p, t), 6) AS intercept, round(avg((abs(p - t) <= 10)::INT), 6) AS within, round(2 * covar_pop(p, t) / (var_pop(p) + var_pop(t) + (avg(p) - avg(t)) ** 2), 6) AS ccc, round(first(w1), 6) AS wasserstein, round(sqrt(avg((p - t) * (p - t))) / nullif(max(t) - min(t), 0), 6) AS nrmse FROM x JOIN w USING (lang) GROUP BY x.lang"),
    "val_micro_macro": (micro_macro, f"{_RUNS}, m AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM cf) SELECT algorithm, params, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM m GROUP BY algorithm, params"),
    "val_majority": (majority, "WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY c DESC) AS r FROM c) SELECT source, CASE WHEN count(*) FILTER (r = 1) = 1 THEN max(lang) FILTER (r = 1) END AS majority, count(*) AS n_distinct FROM r GROUP BY source"),
    "val_pooled_tiles": (pooled_tiles, f"{_RUNS} SELECT algorithm, sample, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(f1 * n) / sum(n), 6) AS f1, round(sum(jaccard * n) / sum(n), 6) AS jaccard FROM wt GROUP BY algorithm, sample"),
    "val_overall": (overall, "SELECT CASE WHEN grouping(lang) = 1 THEN 'OVERALL' ELSE lang END AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), ())"),
    "val_consensus_error": (consensus, f"{_RATED}, x AS (SELECT lang, abs(quality - toxic) AS pe, abs((n_chars % 7) / 6 - (quality + toxic) / 2) AS me FROM ra) SELECT CASE WHEN grouping(lang) = 1 THEN 'OVERALL' ELSE lang END AS lang, count(*) AS n, round(avg(pe), 6) AS pair_error, round(avg(pe) / 2, 6) AS human_error, round(avg(me), 6) AS method_error, round(avg(me) / nullif(avg(pe) / 2, 0), 6) AS ratio FROM x GROUP BY GROUPING SETS ((lang), ())"),
    "val_wilcoxon": (wilcoxon, signed_rank_sql(f"{_RATED}, d AS (SELECT lang, CAST(n_chars % 13 AS DOUBLE) - CAST(n_chars % 11 AS DOUBLE) AS d FROM ra)", "lang", 6)),
    "val_average_precision": (ap, f"{_RATED}, h AS (SELECT lang, doc_id, n_chars % 101 AS score, quality = 1 AS hit, sum((quality = 1)::INT) OVER (PARTITION BY lang) AS nt FROM ra), t AS (SELECT *, sum(hit::INT) OVER o AS tp, row_number() OVER o AS k FROM h WINDOW o AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT lang, score, doc_id, tp / k AS pr, tp / nt AS rc FROM t) SELECT lang, round(sum(st), 6) AS ap FROM (SELECT lang, (rc - coalesce(lag(rc) OVER o, 0)) * (pr + coalesce(lag(pr) OVER o, 1)) / 2 AS st FROM p WINDOW o AS (PARTITION BY lang ORDER BY score DESC, doc_id)) GROUP BY lang"),
    "jn_full_counts": (full_counts, "WITH a AS (SELECT source, count(*) AS n_en FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) AS n_de FROM documents WHERE lang = 'de' GROUP BY 1), c AS (SELECT source, count(*) AS n_fr FROM documents WHERE lang = 'fr' GROUP BY 1) SELECT source, n_en, n_de, n_fr FROM a FULL JOIN b USING (source) FULL JOIN c USING (source)"),
    "agg_pivot_raters": (wide_raters, "SELECT source, " + ", ".join(f"min(n_chars) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source"),
    "prj_unpivot": (unpivoted, "SELECT doc_id, 'quality' AS rater, quality AS vote FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL"),
    "jn_channel_division": (channel_division, "WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type, count(*) AS n, count(*) = (SELECT count(DISTINCT user_id) FROM e) AS everywhere FROM e GROUP BY event_type"),
    "st_last_wins": (last_turns, "SELECT conv_id, arg_max(role, (turn, role)) AS last_role, count(*) AS n_changes FROM conversations GROUP BY conv_id"),
    "set_operations": (set_operations, "WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE n_chars > 9000) SELECT 'union' AS \"set\", source FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', source FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
    "set_unmatched": (unmatched, "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "agg_device_stats": (device_stats, "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.1), 6) AS q10, round(quantile_cont(p_retailprice, 0.9), 6) AS q90, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM part GROUP BY p_brand"),
    "win_tail_epochs": (tail_window, "WITH e AS (SELECT *, datediff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS epoch FROM events), w AS (SELECT *, max(epoch) OVER (PARTITION BY event_type) AS la, min(epoch) OVER (PARTITION BY event_type) AS fi FROM e) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w WHERE epoch > la - 0.1 * (la - fi) GROUP BY event_type"),
    "win_running_maximum": (running_maximum, "WITH q AS (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY p_size) SELECT p_size, round(max(m) OVER (ORDER BY p_size), 6) AS level FROM q"),
}
