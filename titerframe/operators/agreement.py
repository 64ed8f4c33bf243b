"""Validation tables: confusion counts, F1 and Jaccard, rater agreement, count errors, rankings, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import finite, normal_sf, precision_recall_f1


def confusion(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    rows = df.select(*keys, t.alias("__t"), p.alias("__p"))
    t, p = F.col("__t"), F.col("__p")
    return rows.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"))


def weighted_scores(counts: DataFrame) -> DataFrame:
    """F1 and Jaccard averaged over both classes by their support."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))

    n = tp + tn + fp + fn
    f1 = (ratio(2 * tp, 2 * tp + fp + fn) * (tp + fn) + ratio(2 * tn, 2 * tn + fp + fn) * (tn + fp)) / F.when(n > 0, n)
    jaccard = (ratio(tp, tp + fp + fn) * (tp + fn) + ratio(tn, tn + fp + fn) * (tn + fp)) / F.when(n > 0, n)
    return counts.withColumns({"f1": f1, "jaccard": jaccard})


def metric_summary(long: DataFrame, keys: list[str], file_col: str) -> DataFrame:
    """Mean and deviation of per-file scores, summed counts, distinct files."""
    return long.groupBy(*keys).agg(
        F.avg("f1").alias("mean_f1"), A.sd(F.col("f1")).alias("std_f1"), F.avg("jaccard").alias("mean_jaccard"), A.sd(F.col("jaccard")).alias("std_jaccard"),
        *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")], F.countDistinct(file_col).alias("n_files"),
    )


def best_settings(summary: DataFrame, algorithm: str, params: str, score: str, n: int = 1) -> DataFrame:
    """Best n settings of each algorithm; ties to the smaller parameter text."""
    means = summary.groupBy(algorithm, params).agg(F.avg(score).alias("score"))
    order = Window.partitionBy(algorithm).orderBy(F.desc("score"), params)
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with ties at their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2.0


def count_errors(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """Bias, absolute and squared errors, relative error, Pearson and Spearman correlation of counts."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).select(*keys, F.col(predicted).cast("double").alias("p"), F.col(truth).cast("double").alias("t"))
    rows = rows.withColumns({"rp": average_rank("p", keys), "rt": average_rank("t", keys)})
    e = F.col("p") - F.col("t")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), A.median(F.abs(e)).alias("median_abs"),
        F.avg(F.abs(e) / F.when(F.col("t") != 0, F.col("t"))).alias("mean_rel"), F.corr("p", "t").alias("pearson"), F.corr("rp", "rt").alias("spearman"),
    )


def energy_errors(df: DataFrame, keys: list[str], predicted: str, truth: str, delta: float) -> DataFrame:
    """RMSE, normalised RMSE, MAE, regression line, share within ``delta``, concordance, and Wasserstein-1 distance.

    Wasserstein-1 of equally many values is the mean distance of the values of equal rank.
    """
    rows = df.select(*keys, finite(F.col(predicted).cast("double")).alias("p"), finite(F.col(truth).cast("double")).alias("t")).where("p IS NOT NULL AND t IS NOT NULL")
    by = Window.partitionBy(*keys)
    ranked = rows.withColumns({"ip": F.row_number().over(by.orderBy("p")), "it": F.row_number().over(by.orderBy("t"))})
    left, right = ranked.select(*keys, F.col("ip").alias("i"), "p"), ranked.select(*keys, F.col("it").alias("i"), "t")
    w1 = left.join(right, [*keys, "i"]).groupBy(*keys).agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("wasserstein"))
    e = F.col("p") - F.col("t")
    out = rows.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.max("t") - F.min("t")).alias("range"), F.regr_slope("p", "t").alias("slope"), F.regr_intercept("p", "t").alias("intercept"),
        F.avg((F.abs(e) <= delta).cast("int")).alias("within"), A.concordance(F.col("p"), F.col("t")).alias("ccc"),
    )
    return out.join(w1, keys).withColumn("nrmse", F.col("rmse") / F.when(F.col("range") > 0, F.col("range"))).drop("range")


def micro_macro(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 from pooled counts, and the means of the images' own."""
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = df.withColumns({"p": p, "r": r, "f": f})
    out = rows.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f})


def crosstab(df: DataFrame, a: str, b: str, domain: list, normalise: bool = False) -> DataFrame:
    """Counts of all pairs of a domain, zeros included; optionally as shares of a row."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], schema=f"v {df.schema[a].dataType.simpleString()}")  # the domain is a parameter
    grid = values.select(F.col("v").alias(a)).crossJoin(F.broadcast(values.select(F.col("v").alias(b))))
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    out = grid.join(counts, [a, b], "left").fillna(0, ["n"])
    if normalise:
        total = F.sum("n").over(Window.partitionBy(a))
        out = out.withColumn("share", F.col("n") / F.when(total > 0, total))
    return out


def majority(df: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The only most frequent vote of a key, null on ties; and how many different votes there were."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("c"))
    top = counts.withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("c"))))
    first = F.col("r") == 1
    return top.groupBy(*keys).agg(F.when(F.count_if(first) == 1, F.max(F.when(first, F.col(vote)))).alias("majority"), F.count("*").alias("n_distinct"))


def pooled(df: DataFrame, keys: list[str], sums: list[str], means: dict[str, str]) -> DataFrame:
    """Rows of tiles pooled to images: additive columns summed, means weighted by another column."""
    weighted = [(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(w))) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(w))), F.lit(0))).alias(v) for v, w in means.items()]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *weighted)


def with_overall(df: DataFrame, key: str, aggs: list[Column], label: str = "OVERALL") -> DataFrame:
    """An aggregate per key and one over all rows, by grouping sets."""
    out = df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("__all"), *aggs)
    return out.withColumn(key, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(key))).drop("__all")


def consensus_error(df: DataFrame, key: str, raters: tuple[str, str], method: str) -> DataFrame:
    """Raters' mean disagreement halved, the method's error against their mean, and the ratio; per key and overall."""
    a, b = (F.col(r) for r in raters)
    rows = df.where(a.isNotNull() & b.isNotNull() & F.col(method).isNotNull())
    pair, own = F.abs(a - b), F.abs(F.col(method) - (a + b) / 2)
    out = with_overall(rows, key, [F.count("*").alias("n"), F.avg(pair).alias("pair_error"), (F.avg(pair) / 2).alias("human_error"), F.avg(own).alias("method_error")])
    return out.withColumn("ratio", F.col("method_error") / F.when(F.col("human_error") > 0, F.col("human_error")))


#: Up to so many pairs without ties or zeros have an exact p-value.
EXACT_PAIRS = 50


def signed_rank_sums(most: int = EXACT_PAIRS) -> list[tuple[int, float, float]]:
    """(n, w, share of all 2^n signs whose positive ranks sum to w at most), for every w up to the mean sum."""
    rows, ways = [], [1]
    for n in range(1, most + 1):
        longer = ways + [0] * n
        for w, k in enumerate(ways):  # rank n is in the sum or not
            longer[w + n] += k
        ways, below = longer, 0
        for w in range(n * (n + 1) // 4 + 1):
            below += ways[w]
            rows.append((n, float(w), below / 2**n))
    return rows


def signed_ranks(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's statistic of paired values with its two-sided p-value: keys, n_paired, n_nonzero, statistic, p_value.

    Pairs of equal values are left out. The p-value is exact for at most ``EXACT_PAIRS`` pairs if none are left out and no
    differences tie, by the table of :func:`signed_rank_sums` (a row per n and sum, broadcast); else it is the normal one,
    corrected for ties. Fewer than three pairs, or none that differs, have none. Rows with a null side don't count.
    """
    spark = df.sparkSession
    d = F.col(a) - F.col(b)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, d.alias("d"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_paired"), F.count_if(F.col("d") != 0).alias("n_nonzero"))
    nz = rows.where("d <> 0").withColumn("x", F.abs("d"))
    nz = nz.withColumns({"r": average_rank("x", keys), "t": F.count("*").over(Window.partitionBy(*keys, "x"))})
    w = nz.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    out = (counts.join(w, keys, "left") if keys else counts.crossJoin(w)).withColumn("statistic", F.least("w_plus", "w_minus"))
    n = F.col("n_nonzero")
    mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = (F.col("statistic") - mean) / F.sqrt(F.when(var > 0, var))
    sums = F.broadcast(spark.createDataFrame(signed_rank_sums(), "__n long, __w double, __share double"))
    plain = (F.col("ties") == 0) & (n == F.col("n_paired"))
    out = out.join(sums, plain & (n == F.col("__n")) & (F.col("statistic") == F.col("__w")), "left")
    p = F.least(F.lit(1.0), 2.0 * F.coalesce(F.col("__share"), normal_sf(-z)))
    return out.withColumn("p_value", F.when((F.col("n_paired") >= 3) & F.col("statistic").isNotNull(), p)).drop("ties", "w_plus", "w_minus", "__n", "__w", "__share")


def average_precision(df: DataFrame, keys: list[str], score: str, hit: str, n_truth: str, row: str) -> DataFrame:
    """Area under precision over recall by trapezoids, detections in order of falling score."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
    run = df.withColumns({"tp": F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(order)})
    run = run.withColumns({"precision": F.col("tp") / F.col("k"), "recall": F.col("tp") / F.col(n_truth)})
    step = (F.col("recall") - F.coalesce(F.lag("recall").over(order), F.lit(0.0))) * (F.col("precision") + F.coalesce(F.lag("precision").over(order), F.lit(1.0))) / 2.0
    return run.withColumn("step", step).groupBy(*keys).agg(F.sum("step").alias("ap"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; fails at run time if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__ok", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))).where("__ok").drop("__ok")


def join_counts(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of per-image counts (keys, n), one row a key on every side; columns named by side."""
    out = None
    for name, df in sides.items():
        df = assert_unique(df, keys).withColumnRenamed("n", name)
        out = df if out is None else out.join(df, keys, "full")
    return out


def merge_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of result shards of one schema; fails on a schema that differs and on a repeated key."""
    first = shards[0]
    for s in shards[1:]:
        if sorted(s.dtypes) != sorted(first.dtypes):
            raise ValueError("shards differ in schema")
        first = first.unionByName(s)
    return assert_unique(first, keys)


def same_channels(panels: DataFrame, file_col: str, channel: str, n_files: int) -> DataFrame:
    """Channels that every file has (relational division) and the others, with their counts."""
    return panels.groupBy(channel).agg(F.countDistinct(file_col).alias("n")).withColumn("everywhere", F.col("n") == n_files)
