"""Report and validation views: points, labels, curves, checks, training pools, summaries, instance comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import finite, precision_recall_f1
from .sampling import drawn, sample_per_group
from .spatial import overlaps
from .statistics import exact_quantiles

#: Metric columns of validation tables start with one of these. Fixed values.
METRIC_PREFIXES = ("mask_", "boundary_", "center_", "energy_", "count_error_", "abs_count_error_")
#: IoU thresholds of instance comparison. Fixed values.
IOU_THRESHOLDS = (0.10, 0.25, 0.30, 0.50, 0.70, 0.75, 0.90)


# ------------------------------------------------------------------------------------------------------------- views


def matrix_rows(spark, names: list[str], matrix: list[list[float]]) -> DataFrame:
    """A labelled square matrix as rows: row, column, value. Its size is the number of channels."""
    rows = spark.createDataFrame([(names[i], [float(v) for v in r]) for i, r in enumerate(matrix)], "row string, v array<double>")
    return rows.select("row", F.posexplode("v").alias("at", "value")).select("row", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("column"), "value")


def plot_points(events: DataFrame, keys: list[str], row: list[str], x: str, y: str, gate: Column, n: int) -> DataFrame:
    """Points of a scatter plot per group: at most ``n`` events as an array of (x, y, inside), in row order."""
    rows = sample_per_group(events.withColumn("__in", F.coalesce(gate, F.lit(False))), keys, row, n, ties=[x, y, "__in"])
    point = F.struct(*row, F.col(x).alias("x"), F.col(y).alias("y"), F.col("__in").alias("inside"))
    points = F.sort_array(F.collect_list(point))  # n at most
    return rows.groupBy(*keys).agg(points.alias("p")).select(*keys, F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["inside"].alias("inside"))).alias("points"))


def display_labels(markers: DataFrame, keys: list[str], marker: str, population: str, order: str) -> DataFrame:
    """Adds a label per marker: its population, or its own name; a label seen before gets the marker's name behind it."""
    own = F.coalesce(F.nullif(F.trim(F.col(population)), F.lit("")), F.col(marker))
    rows = markers.withColumn("__own", own)
    seen = F.row_number().over(Window.partitionBy(*keys, "__own").orderBy(order))
    return rows.withColumn("label", F.when(seen > 1, F.concat("__own", F.lit(" ("), F.col(marker), F.lit(")"))).otherwise(F.col("__own"))).drop("__own")


def axis_label(label: Column, marker: Column) -> Column:
    """Label of a marker's axis: ``marker (label)``, or what there is of both."""
    label, marker = F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(marker, F.lit("")))
    without = F.when(label != "", F.concat(label, F.lit(" marker"))).otherwise("marker")
    return F.when(marker == "", without).when((label == "") | (label == marker), marker).otherwise(F.concat(marker, F.lit(" ("), label, F.lit(")")))


def gate_options(events: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    """The gates that a group can show, in the order given: those with an event. keys, gate, n."""
    counts = events.groupBy(*keys).agg(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(g).alias("gate"), F.count_if(c).alias("n")) for i, (g, c) in enumerate(gates.items())]).alias("g"))
    return counts.select(*keys, F.inline("g")).where("n > 0")


def flat_meta(df: DataFrame, keys: list[str], meta: str, prefix: str = "meta__") -> DataFrame:
    """A JSON object's fields as rows: keys, name with its prefix, value; nested objects by their own fields' names."""
    top = F.explode(F.from_json(F.col(meta), "map<string,string>")).alias("k", "v")
    rows = df.select(*keys, top)
    nested = F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), "map<string,string>")
    fields = F.when(nested.isNotNull(), F.transform(F.map_entries(nested), lambda e: F.struct(F.concat(F.col("k"), F.lit("__"), e["key"]).alias("k"), e["value"].alias("v"))))
    return rows.select(*keys, F.inline(F.coalesce(fields, F.array(F.struct("k", "v"))))).select(*keys, F.concat(F.lit(prefix), F.col("k")).alias("name"), F.col("v").alias("value"))


def mask_of(gates: dict[str, Column], *wanted: str) -> Column:
    """The mask of the first name that there is: gate, then population, then the broad gate."""
    have = [gates[w] for w in wanted if w in gates]
    if not have:
        raise KeyError(f"none of {wanted} in {sorted(gates)}")
    return F.coalesce(*have, F.lit(False))


def assert_subset(df: DataFrame, inner: Column, outer: Column, message: str) -> DataFrame:
    """``df``; fails at run time where a row is in the inner mask but not in the outer one."""
    bad = F.coalesce(inner, F.lit(False)) & ~F.coalesce(outer, F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def curves(histogram: DataFrame, keys: list[str], series: str) -> DataFrame:
    """Histograms (keys, series, bin, n, lo, width) as drawable lines: a row per series with its bins' centres and densities."""
    total = F.sum("n").over(Window.partitionBy(*keys, series))
    rows = histogram.withColumns({"x": F.col("lo") + (F.col("bin") + 0.5) * F.col("width"), "d": F.col("n") / F.when(total > 0, total)})
    line = F.sort_array(F.collect_list(F.struct("bin", "x", "d")))  # one row a bin
    return rows.groupBy(*keys, series).agg(line.alias("l")).select(*keys, series, F.transform("l", lambda p: p["x"]).alias("x"), F.transform("l", lambda p: p["d"]).alias("density"))


def file_view(readouts: DataFrame, lines: DataFrame, controls: DataFrame, gate: str) -> DataFrame:
    """What a file's page shows of one gate: its metrics, the controls' cutoff and the lines of all series."""
    one = readouts.where(F.col("gate") == gate).join(controls.where(F.col("gate") == gate).select("gate", "cutoff"), "gate")
    drawn_lines = lines.agg(F.sort_array(F.collect_list(F.struct("role", "x", "density"))).alias("series"))  # a row per role
    return one.crossJoin(F.broadcast(drawn_lines))  # one row


def full_views(
    events: DataFrame, readouts: DataFrame, controls: DataFrame, file_col: str, role_col: str, row: list[str], x: str, y: str, t: str, gate: str, mask: Column, n_points: int = 500, bins: int = 64
) -> DataFrame:
    """A row per file with all that its page shows of a gate: metrics, cutoff, scatter points of the file and of both
    controls, and the density lines of the file and of the controls over the range of all three.

    Columns: those of ``readouts``, cutoff, points, nc_points, pc_points (arrays of x, y, inside; at most ``n_points``
    each, drawn by hash), lines (array of series, x, density). Files without an event in the gate have no lines.
    """
    controls_only = events.where(F.col(role_col).isin("NC", "PC"))
    own = plot_points(events, [file_col], row, x, y, mask, n_points)
    pooled = plot_points(controls_only, [role_col], [file_col, *row], x, y, mask, n_points)
    sides = pooled.agg(*[F.max_by("points", F.when(F.col(role_col) == r, 1)).alias(f"{r.lower()}_points") for r in ("NC", "PC")])  # two rows
    inside = events.where(F.coalesce(mask, F.lit(False)))
    limits = exact_quantiles(inside, [], t, [0.001, 0.999]).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    limits = limits.withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))

    def lines(rows: DataFrame, keys: list[str], name: Column) -> DataFrame:
        at = F.floor((finite(F.col(t)) - F.col("lo")) / F.col("width")).cast("int")
        met = rows.crossJoin(F.broadcast(limits)).withColumn("bin", F.least(at, F.lit(bins - 1)))  # one row of limits
        counts = met.where((F.col(t) >= F.col("lo")) & (F.col(t) <= F.col("hi"))).groupBy(*keys, "bin", "lo", "width").agg(F.count("*").alias("n"))
        whole = F.sum("n").over(Window.partitionBy(*keys))
        counts = counts.withColumn("w", whole).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("x"), (F.col("n") / F.col("w")).alias("d")))).alias("l"))
        return counts.select(*keys, F.struct(name.alias("series"), F.transform("l", lambda p: p["x"]).alias("x"), F.transform("l", lambda p: p["d"]).alias("density")).alias("line"))

    mine = lines(inside, [file_col], F.lit("file"))
    theirs = lines(inside.where(F.col(role_col).isin("NC", "PC")), [role_col], F.col(role_col)).agg(F.sort_array(F.collect_list("line")).alias("controls"))  # two rows
    view = readouts.where(F.col("gate") == gate).join(controls.where(F.col("gate") == gate).select("gate", "cutoff"), "gate")
    view = view.join(own, file_col, "left").join(mine, file_col, "left").crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(theirs))  # one row each
    return view.withColumn("lines", F.when(F.col("line").isNotNull(), F.concat(F.array("line"), F.col("controls")))).drop("line", "controls")


def spill_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Spillover keywords (``n, names, n * n values``) as labelled matrix rows: keys, row, column, value.

    Null, empty and malformed texts give no rows.
    """
    parts = F.filter(F.transform(F.split(F.col(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    rows = texts.select(*keys, parts.alias("__p")).withColumn("__n", F.get("__p", F.lit(0)).try_cast("int"))
    rows = rows.where((F.col("__n") > 0) & (F.size("__p") == 1 + F.col("__n") + F.col("__n") * F.col("__n")))
    values = F.slice("__p", F.col("__n") + 2, F.col("__n") * F.col("__n"))
    rows = rows.select(*keys, "__n", "__p", F.posexplode(values).alias("__at", "__v"))
    name = lambda i: F.element_at("__p", (i + 2).cast("int"))
    return rows.select(*keys, name(F.floor(F.col("__at") / F.col("__n"))).alias("row"), name(F.col("__at") % F.col("__n")).alias("column"), F.col("__v").try_cast("double").alias("value"))


# ------------------------------------------------------------------------------------------------------------ samples


def training_pool(events: DataFrame, file_col: str, row: list[str], mask: Column, markers: list[str], per_file: int, tail_q: float = 0.99, tail: int = 250, least: int = 200) -> DataFrame:
    """Training rows of every file: a base sample inside the mask, and per marker a sample of its upper tail.

    Markers with fewer than ``least`` finite values in a file boost nothing there. A row that is drawn twice counts once.
    Events move once, by file: all samples are ranks in windows over it. Rows with a null in their key are not drawn.
    """
    file, inside = Window.partitionBy(file_col), F.col("__in")

    def taken(seed: int, among: str, size: str, n: int) -> Column:
        """The rows of a mask that :func:`sample_per_group` takes; no hash where all are."""
        order = Window.partitionBy(file_col, among).orderBy(F.when(F.col(among) & (F.col(size) > n), drawn(seed, row)), *row)
        return F.col(among) & (F.row_number().over(order) <= n)

    rows = events.withColumn("__in", F.coalesce(mask, F.lit(False)))
    facts = {"__size": F.count_if(inside).over(file)}
    for i, m in enumerate(markers):
        x = finite(F.col(m))
        facts |= {f"__n{i}": F.count(F.when(inside, x)).over(file), f"__q{i}": A.quantile(F.col(m), tail_q, inside).over(file)}
    rows = rows.withColumns(facts)
    upper = {f"__up{i}": F.coalesce(inside & (F.col(f"__n{i}") >= least) & (finite(F.col(m)) >= F.col(f"__q{i}")), F.lit(False)) for i, m in enumerate(markers)}
    rows = rows.withColumns(upper).withColumns({f"__size{i}": F.count_if(F.col(f"__up{i}")).over(file) for i in range(len(markers))})
    rows = rows.withColumn("__taken", taken(0, "__in", "__size", per_file))
    for i in range(len(markers)):
        rows = rows.withColumn("__taken", F.col("__taken") | taken(i + 1, f"__up{i}", f"__size{i}", tail))
    key = [file_col, *row]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    # rows with the key of a drawn one come along
    return rows.where(known).withColumn("__taken", F.max("__taken").over(Window.partitionBy(*key))).where("__taken").select(*key, *[c for c in events.columns if c not in key])


def sample_with_replacement(df: DataFrame, keys: list[str], row: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws per group with replacement (draw: 0 to n - 1); the draw's hash picks the row, so reruns agree."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    draws = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.select(*keys, "draw", (value % F.col("__n")).alias("__i"))
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*row)) - 1)
    return rows.join(draws, [*keys, "__i"]).drop("__i")


def running_count(df: DataFrame, keys: list[str], order: list[str], out: str = "i") -> DataFrame:
    """Numbers a group's rows from 0 in the order given."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


# ---------------------------------------------------------------------------------------------------------- summaries


def qc_summary(wells: DataFrame, keys: list[str], min_rois: int = 50, max_uncertain: float = 0.25) -> DataFrame:
    """Per plate: wells, those of few ROIs and of many uncertain ones by name, means and warnings."""
    low, high = F.col("n_rois") < min_rois, F.col("frac_uncertain") > max_uncertain
    names = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("well"))))  # noqa: E731  a plate's wells
    out = wells.groupBy(*keys).agg(F.count("*").alias("total_wells"), names(low).alias("low_roi_wells"), names(high).alias("high_uncertain_wells"), F.avg("n_rois").alias("mean_n_rois"), F.avg("frac_uncertain").alias("mean_uncertain_fraction"))
    say = lambda c, what: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" well(s) have {what}.")))
    warnings = F.array_compact(F.array(say("low_roi_wells", "low ROI count"), say("high_uncertain_wells", "high uncertain fraction")))
    return out.withColumns({"valid_wells": F.col("total_wells") - F.size("low_roi_wells"), "warnings": warnings})


def runtime_breakdown(summary: DataFrame, best: DataFrame, algorithm: str, params: str, columns: list[str]) -> DataFrame:
    """Mean seconds of every stage for the best setting of each algorithm."""
    return summary.join(best.select(algorithm, params), [algorithm, params], "left_semi").groupBy(algorithm, params).agg(*[F.avg(c).alias(c) for c in columns])


def prefixed_means(df: DataFrame, keys: list[str], prefixes=METRIC_PREFIXES) -> DataFrame:
    """Mean and population deviation of every metric column (found by its prefix): keys, metric, mean, sd. Not-finite values are missing."""
    metrics = [c for c in df.columns if c.startswith(tuple(prefixes))]
    long = df.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in metrics]).unpivot(keys, metrics, "metric", "v")
    return long.groupBy(*keys, "metric").agg(F.avg(finite(F.col("v"))).alias("mean"), F.stddev_pop(finite(F.col("v"))).alias("sd"))


def simulation_parameters(rows: DataFrame, keys: list[str], meta: str, schema: str, **labels: str) -> DataFrame:
    """The ``sim_kwargs`` of JSON meta as columns, with constant columns that say where they come from."""
    parsed = rows.select(*keys, F.from_json(F.col(meta), f"sim_kwargs struct<{schema}>").alias("m"))
    return parsed.select(*keys, "m.sim_kwargs.*").withColumns({k: F.lit(v) for k, v in labels.items()})


def disagreements(votes: DataFrame, case: list[str], annotator: str, score: str, expected: int, both: tuple[int, int] = (2, 4), valid=(0, 1, 2, 4, 6, 8)) -> DataFrame:
    """Cases whose votes hold both scores, and cases that have no proper set of votes, with the reason.

    A proper set is one valid score of each of ``expected`` annotators. Columns: case, votes text, reason (null for a
    disagreement), n_distinct, majority (null on ties), kind.
    """
    single = votes.groupBy(*case, annotator).agg(F.countDistinct(score).alias("k"), F.min(score).alias("v"))
    out = single.groupBy(*case).agg(F.count("*").alias("n"), F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct(F.col(annotator).alias("a"), F.col("v").alias("v")))).alias("all"))
    values = F.transform("all", lambda p: p["v"])
    broken = F.when((F.col("n") != expected) | (F.col("k") != 1), "missing_or_conflicting_annotations").when(F.exists(values, lambda v: v.isNull() | ~v.isin(*valid)), "invalid_score")
    out = out.withColumns({"reason": broken, "votes": F.array_join(F.transform("all", lambda p: F.concat_ws(":", p["a"].cast("string"), p["v"].cast("string"))), ";"), "n_distinct": F.size(F.array_distinct(values))})
    out = out.where(F.col("reason").isNotNull() | (F.array_contains(values, both[0]) & F.array_contains(values, both[1])))
    times = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), v.alias("v")))
    top = F.filter(times, lambda t: t["n"] == F.array_max(times)["n"])
    kind = F.when(F.col("n_distinct") == 3, "three_way").when(F.lit(expected == 3), "two_vs_one").otherwise("two_annotator")
    fine = F.col("reason").isNull()
    return out.select(*case, "votes", "reason", F.when(fine, F.col("n_distinct")).alias("n_distinct"), F.when(fine & (F.size(top) == 1), top[0]["v"]).alias("majority"), F.when(fine, kind).alias("kind"))


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in no row of the exclusion table; null keys match null keys."""
    other = excluded.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return df.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


# ---------------------------------------------------------------------------------------------------------- instances


def evaluation_region(truth: DataFrame, keys: list[str], margin: int, height: int, width: int) -> DataFrame:
    """Bounding box of the labelled pixels with a margin, inside the image: keys, top, left, bottom, right (exclusive)."""
    box = truth.where("label > 0").groupBy(*keys).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - margin)
    return box.select(*keys, low("y0").alias("top"), low("x0").alias("left"), F.least(F.lit(height), F.col("y1") + margin + 1).alias("bottom"), F.least(F.lit(width), F.col("x1") + margin + 1).alias("right"))


def clean_circles(circles: DataFrame, keys: list[str], order: str, height: Column | int, width: Column | int, geometry=("roi_x_px", "roi_y_px", "center_x_px", "center_y_px", "diameter_px")) -> DataFrame:
    """Circles with numeric geometry: those fully outside the image go, and repeats of one geometry after the first."""
    rows = circles.withColumns({c: F.col(c).try_cast("double") for c in geometry})
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
    x0, y0, d = F.col(geometry[0]), F.col(geometry[1]), F.col(geometry[4])
    outside = F.coalesce((x0 + d <= 0) | (y0 + d <= 0) | (x0 >= w) | (y0 >= h), F.lit(False))
    first = F.row_number().over(Window.partitionBy(*keys, *geometry).orderBy(order))
    return rows.where(~outside).withColumn("__r", first).where("__r = 1").drop("__r")


def instance_scores(truth: DataFrame, predicted: DataFrame, keys: list[str], thresholds=tuple(t for t in IOU_THRESHOLDS if t > 0.5)) -> DataFrame:
    """Object scores per image and IoU threshold over 0.5: matches, misses, precision, recall, F1, mean IoU, panoptic quality.

    Above one half a region overlaps one other region only, so the pairs that reach the threshold are the one-to-one
    assignment; for lower thresholds match the pairs by :func:`spatial.match_pairs`.
    """
    if min(thresholds) <= 0.5:
        raise ValueError("thresholds must exceed 0.5")
    pairs = overlaps(truth, predicted, keys)
    count = lambda df, n: df.where("label > 0").groupBy(*keys).agg(F.countDistinct("label").alias(n))
    sizes = count(truth, "n_truth").join(count(predicted, "n_predicted"), keys, "full").fillna(0, ["n_truth", "n_predicted"])
    grid = sizes.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col("iou") >= t).alias("tp"), F.sum(F.when(F.col("iou") >= t, F.col("iou"))).alias("total")) for t in thresholds])
    hits = pairs.groupBy(*keys).agg(hit.alias("h")).select(*keys, F.inline("h"))
    out = grid.join(hits, [*keys, "threshold"], "left").fillna(0, ["tp", "total"]).withColumns({"fp": F.col("n_predicted") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp")})
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    half = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    return out.withColumns({"precision": p, "recall": r, "f1": f, "mean_iou": F.col("total") / F.when(F.col("tp") > 0, F.col("tp")), "pq": F.when(half > 0, F.col("total") / F.when(half > 0, half)).otherwise(1.0)}).drop("total")


def splits_and_merges(truth: DataFrame, predicted: DataFrame, keys: list[str], fraction: float = 0.10) -> DataFrame:
    """Regions that several regions of the other side cover by ``fraction`` of their own area at least: keys, splits, merges.

    Images of either side have a row, those whose sides share no pixel too.
    """
    pairs = overlaps(truth, predicted, keys)
    split = pairs.where(F.col("inter") >= fraction * F.col("t_area")).groupBy(*keys, "t").count().where("count > 1").groupBy(*keys).agg(F.count("*").alias("splits"))
    merge = pairs.where(F.col("inter") >= fraction * F.col("p_area")).groupBy(*keys, "p").count().where("count > 1").groupBy(*keys).agg(F.count("*").alias("merges"))
    images = truth.select(*keys).union(predicted.select(*keys)).distinct()
    return images.join(split, keys, "left").join(merge, keys, "left").fillna(0, ["splits", "merges"])


def rewritten(df: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    """Texts with every name replaced by its alias, longest names first. ``names`` is a parameter, not a table."""
    new = {}
    for c in columns:
        new[c] = reduce(lambda x, n: F.replace(x, F.lit(n), F.lit(names[n])), sorted(names, key=lambda n: (-len(n), n)), F.col(c))
    return df.withColumns(new)


def ground_truth_column(columns: list[str], gate: str) -> str:
    """Name of a manual gate's column: as it is, without singlets in its path, or the only one with its path's tail."""
    for name in (gate, gate.replace("/singlets", "")):
        if name in columns:
            return name
    tail = gate[gate.index("/lymphocytes") :] if "/lymphocytes" in gate else gate
    found = [c for c in columns if c.endswith(tail)]
    if len(found) != 1:
        raise KeyError(f"no single column for {gate} in {columns}")
    return found[0]
