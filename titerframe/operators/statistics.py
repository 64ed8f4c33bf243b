"""Order statistics and histograms per group, as joins of small group tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import finite, skip_outliers
from .staging import staged, unstaged


def with_mad(df: DataFrame, keys: list[str], value: str, med: str = "med", mad: str = "mad") -> DataFrame:
    """Median and median absolute deviation per group (keys, med, mad): two aggregations, no ordered window."""
    meds = df.groupBy(*keys).agg(A.median(F.col(value)).alias(med))
    joined = df.join(meds, keys) if keys else df.crossJoin(F.broadcast(meds))  # without keys: one row
    return joined.groupBy(*keys, med).agg(A.median(F.abs(F.col(value) - F.col(med))).alias(mad))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str, eps: float = 1e-6, clip: float = 8.0) -> DataFrame:
    """``(x - median) / max(MAD, eps)``, clipped."""
    stats = with_mad(df, keys, value, "__med", "__mad")
    z = (F.col(value) - F.col("__med")) / F.greatest(F.col("__mad"), F.lit(eps))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # without keys: one row
    return joined.withColumn(out, skip_outliers(z, clip)).drop("__med", "__mad")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str = "quantile") -> DataFrame:
    """Smallest value at which the running weight reaches q of all weight; weights must be positive.

    The different values are dealt out by ranges of their order. Sums of the ranges say in which one the weight is
    reached, and only its values are put in order by one task.
    """
    x, w = finite(F.col(value)), finite(F.col(weight))
    rows = df.select(*keys, x.alias("x"), w.alias("w")).where("x IS NOT NULL AND w > 0").groupBy(*keys, "x").agg(F.sum("w").alias("w"))
    rows = staged(rows, "weights")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 200_000)
    rows = staged(rows.repartitionByRange(n, *keys, "x").withColumn("part", F.spark_partition_id()), "weight-ranges")
    own = Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, "part").agg(F.sum("w").alias("all"))
    sums = sums.withColumns({"upto": F.sum("all").over(own.orderBy("part")), "total": F.sum("all").over(own)})
    sums = sums.withColumns({"least": q * F.col("total"), "before": F.col("upto") - F.col("all")})
    # the last range where rounding keeps the weight from being reached
    reached = F.coalesce(F.min(F.when(F.col("upto") >= F.col("least"), F.col("part"))).over(own), F.max("part").over(own))
    hit = sums.withColumn("hit", reached).where("part = hit").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), "before", "least")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("part") == F.col("__part"))
    rows = rows.join(F.broadcast(hit), same)  # a row per group
    rows = rows.withColumn("cw", F.col("before") + F.sum("w").over(Window.partitionBy(*keys).orderBy("x")))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("cw") >= F.col("least"), F.col("x"))), F.max("x")).alias(out))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 256, low_q: float = 0.001, high_q: float = 0.999, pad: float = 0.02) -> DataFrame:
    """Counts per bin (keys, bin, n, lo, width) over the padded robust range; empty bins are there with 0.

    The last bin is closed. Values outside the range are not counted.
    """
    x = F.col(value)
    ends = exact_quantiles(df, keys, value, [low_q, high_q])
    ends = ends.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    extremes = df.groupBy(*keys).agg(F.min(finite(x)).alias("least"), F.max(finite(x)).alias("most"))
    return _counted(df, keys, value, _padded(_beside(extremes, ends, keys), pad), bins)


def _padded(ranges: DataFrame, pad: float) -> DataFrame:
    flat = F.col("b") <= F.col("a")
    ranges = ranges.withColumns({"a": F.when(flat, F.col("least")).otherwise(F.col("a")), "b": F.when(flat, F.col("most")).otherwise(F.col("b"))})
    ranges = ranges.withColumn("b", F.when(F.col("b") <= F.col("a"), F.col("a") + 1.0).otherwise(F.col("b")))
    return ranges.withColumns({"lo": F.col("a") - pad * (F.col("b") - F.col("a")), "hi": F.col("b") + pad * (F.col("b") - F.col("a"))}).drop("a", "b", "least", "most")


def _counted(df: DataFrame, keys: list[str], value: str, ranges: DataFrame, bins: int) -> DataFrame:
    ranges = ranges.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    joined = df.select(*keys, finite(F.col(value)).alias("x")).join(F.broadcast(ranges), keys)  # a row per group
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = joined.where("x >= lo AND x <= hi").groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo", "width")


def smoothed(n: Column, keys: list[Column | str], order: str = "bin", width: int = 7) -> Column:
    """Centred moving average with zeros beyond the ends: the sum is divided by ``width`` always."""
    half = width // 2
    return F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)) / width


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group; without keys the small table has one row."""
    return rows.join(small, keys) if keys else rows.crossJoin(F.broadcast(small))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, qs: list[float], only: Callable[[Column], Column] | None = None, near: float = 0.005, bins: int = 512, few: int = 2000, in_task: int = 500_000
) -> DataFrame:
    """Exact quantiles with linear interpolation per group of any size: keys, q (one of ``qs``), x.

    Every rank is bracketed: by approximate quantiles whose error is a fifth of ``near``, in groups of at most ``few``
    rows by their extremes. The different values inside a bracket are counted, in equal bins; a bin whose values are
    equal, or at whose end the rank lies, gives its value at once. Else the values of the bin that holds the rank are
    put in order, or binned again as long as there are over ``in_task`` of them. Ties cost nothing, as a value is one
    row however often it occurs. ``only`` tells from the keys whether a q is asked. Missing values don't count; null keys
    are no group; a group without values has no row.
    """
    rows = df.select(*keys, finite(F.col(value)).cast("double").alias("__x")).where("__x IS NOT NULL")
    sides = [q + s * near for s in (-1, 1) for q in qs]
    ends = F.percentile_approx("__x", [min(1.0, max(0.0, p)) for p in sides], F.lit(int(5 / near)))
    groups = rows.groupBy(*keys).agg(ends.alias("__ends"), F.count("*").alias("__n"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
    ask = [F.lit(True) if only is None else only(F.lit(float(q))) for q in qs]
    small = F.col("__n") <= few
    lo = [F.when(ask[i], F.when(small | F.lit(q <= near), F.col("__least")).otherwise(F.col("__ends")[i])).alias(f"lo{i}") for i, q in enumerate(qs)]
    hi = [F.when(ask[i], F.when(small | F.lit(q >= 1 - near), F.col("__most")).otherwise(F.col("__ends")[i + len(qs)])).alias(f"hi{i}") for i, q in enumerate(qs)]
    named, keys = keys, [f"__k{i}" for i in range(len(keys))]  # no key's name clashes with a column below
    own = [F.col(k).alias(n) for k, n in zip(named, keys, strict=True)]
    bounds = staged(groups.where("__n > 0").select(*own, F.col("__n").alias("n"), *lo, *hi), "bounds")
    rows = rows.select(*own, F.col("__x").alias("x"))

    met = _beside(rows, bounds.drop("n"), keys)
    inside = [F.coalesce(F.col("x").between(F.col(f"lo{i}"), F.col(f"hi{i}")), F.lit(False)) for i in range(len(qs))]
    place = F.array(*[F.when(c, F.struct(F.lit(float(q)).alias("q"), _bin("x", f"lo{i}", f"hi{i}", bins).alias("bin"))) for i, (q, c) in enumerate(zip(qs, inside, strict=True))])
    placed = met.where(reduce(lambda a, b: a | b, inside)).select(*keys, "x", F.explode(F.array_compact(place)).alias("p")).select(*keys, "p.*", "x")
    counts = staged(placed.groupBy(*keys, "q", "bin", "x").agg(F.count("*").alias("c")), "near-ranks")
    below = met.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.count_if(F.col("x") < F.col(f"lo{i}")).alias("before")) for i, q in enumerate(qs)]).alias("b"))
    at = F.col("q") * (F.col("n") - 1)
    ranks = _beside(below, bounds.select(*keys, "n"), keys).select(*keys, "n", F.inline("b")).select(*keys, "q", "before", F.floor(at).alias("r0"), F.ceil(at).alias("r1"), (at - F.floor(at)).alias("share"))

    parts, scratch = [], [bounds, counts]
    while True:
        found = staged(_bins_of_ranks(counts, ranks, [*keys, "q"]), "rank-bins")
        scratch.append(found)
        parts.append(found.where("NOT open").groupBy(*keys, "q").agg(F.max("v0").alias("v0"), F.max("v1").alias("v1"), F.first("share").alias("share")))
        unsure = found.where("open").select(*keys, "q", "bin", "before", "r0", "r1", "share", "least", "most", "different")
        most = unsure.agg(F.max("different")).first()[0]
        if not most:
            break
        counts = counts.join(unsure, [*keys, "q", "bin"])
        if most <= in_task:
            upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("x"))
            ordered = counts.withColumn("upto", upto).groupBy(*keys, "q")
            parts.append(ordered.agg(*[F.min(F.when(F.col("upto") > F.col(r), F.col("x"))).alias(v) for r, v in (("r0", "v0"), ("r1", "v1"))], F.first("share").alias("share")))
            break
        ranks = unsure.select(*keys, "q", "before", "r0", "r1", "share")
        counts = staged(counts.select(*keys, "q", _bin("x", "least", "most", bins).alias("bin"), "x", "c"), "near-ranks")
        scratch.append(counts)
    back = [F.col(n).alias(k) for k, n in zip(named, keys, strict=True)]
    out = staged(reduce(DataFrame.union, parts).select(*back, "q", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("share")).alias("x")), "quantiles")
    unstaged(*scratch)
    return out


def _bin(x: str, lo: str, hi: str, bins: int) -> Column:
    """Which of ``bins`` equal bins between two columns a value is in; halves, as the span may exceed the largest double."""
    width = F.col(hi) / bins - F.col(lo) / bins
    return F.when(width > 0, F.least(F.floor((F.col(x) - F.col(lo)) / width), F.lit(bins - 1))).otherwise(0).cast("int")


def _bins_of_ranks(counts: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The bins that hold the ranks r0 and r1, with the values there (v0, v1) where they are an end of the bin."""
    per_bin = counts.groupBy(*by, "bin").agg(F.sum("c").alias("c"), F.count("*").alias("different"), F.min("x").alias("least"), F.max("x").alias("most")).join(ranks, by)
    start = F.col("before") + F.sum("c").over(Window.partitionBy(*by).orderBy("bin")) - F.col("c")
    per_bin = per_bin.withColumn("before", start).withColumn("end", F.col("before") + F.col("c"))
    holds = [(F.col(r) >= F.col("before")) & (F.col(r) < F.col("end")) for r in ("r0", "r1")]
    flat = F.col("least") == F.col("most")
    values = [F.when(h, F.when(flat | (F.col(r) == F.col("before")), F.col("least")).when(F.col(r) == F.col("end") - 1, F.col("most"))) for h, r in zip(holds, ("r0", "r1"), strict=True)]
    out = per_bin.where(holds[0] | holds[1]).withColumns({"v0": values[0], "v1": values[1]})
    # ranks in different bins are the last of the one and the first of the other, so an open bin holds both
    return out.withColumn("open", (holds[0] & F.col("v0").isNull()) | (holds[1] & F.col("v1").isNull()))


def histogram_cutoff(values: DataFrame, gate: str, role: str, value: str, min_nc: int = 2000, min_pc: int = 2000, bins: int = 256, smooth: int = 7, tail: float = 0.15, run: int = 4, fallback_q: float = 0.90, crossing: float = 0.25) -> DataFrame:
    """Positivity cutoff per gate (gate, n_nc, n_pc, cutoff) from control histograms.

    With enough positive-control events: the first bin right of the negative control's peak where the positive
    density reaches the negative one, which must be down to ``crossing`` of its peak. Else, or if there is none: the
    first of ``run`` bins in a row at ``tail`` of the peak or less. Too few negative-control events, or no such tail:
    their ``fallback_q`` quantile; none at all: 0.
    """
    options = {"min_nc": min_nc, "min_pc": min_pc, "bins": bins, "smooth": smooth, "tail": tail, "run": run, "fallback_q": fallback_q, "crossing": crossing}
    return control_table(values, gate, role, value, value, **options).select("gate", "n_nc", "n_pc", "cutoff")


def control_table(events: DataFrame, gate: str, role: str, raw: str, t: str, min_nc: int = 2000, min_pc: int = 2000, bins: int = 256, smooth: int = 7, tail: float = 0.15, run: int = 4, fallback_q: float = 0.90, crossing: float = 0.25) -> DataFrame:
    """Events and medians of both controls per gate with the cutoff of :func:`histogram_cutoff` on ``t``.

    The control events are written once; gates of any size are handled, as their quantiles are exact selections.
    """
    groups = events.select(F.col(gate).alias("gate")).distinct()
    some = events.where(F.col(role).isin("NC", "PC")).select(F.col(gate).alias("gate"), F.col(role).alias("role"), finite(F.col(raw)).alias("raw"), finite(F.col(t)).alias("x"))
    some = staged(some, "controls")
    kinds = F.array(F.struct(F.concat("role", F.lit(" raw")).alias("of"), F.col("raw").alias("v")), F.struct(F.col("role").alias("of"), F.col("x").alias("v")), F.struct(F.lit("both").alias("of"), F.col("x").alias("v")))
    long = some.select("gate", F.explode(kinds).alias("k")).select("gate", "k.of", "k.v")
    asked = lambda q: F.when(F.col("of") == "both", q.isin(0.001, 0.999)).when(F.col("of") == "NC", F.lit(True)).otherwise(q == 0.5)
    found = exact_quantiles(long, ["gate", "of"], "v", sorted({0.001, 0.5, fallback_q, 0.999}), asked)
    pick = lambda of, q: F.max(F.when((F.col("of") == of) & (F.col("q") == q), F.col("x")))
    names = {"nc_median_raw": ("NC raw", 0.5), "nc_median_t": ("NC", 0.5), "pc_median_raw": ("PC raw", 0.5), "pc_median_t": ("PC", 0.5), "fallback": ("NC", fallback_q)}
    names |= {"nc_a": ("NC", 0.001), "nc_b": ("NC", 0.999), "both_a": ("both", 0.001), "both_b": ("both", 0.999)}
    quantiles = found.groupBy("gate").agg(*[pick(*v).alias(k) for k, v in names.items()])
    nc = F.col("role") == "NC"
    good = F.col("x").isNotNull()
    counts = some.groupBy("gate").agg(F.count_if(nc & good).alias("n_nc"), F.count_if(~nc & good).alias("n_pc"), *[f(F.when(c, F.col("x"))).alias(n) for n, f, c in (("nc_least", F.min, nc), ("nc_most", F.max, nc), ("both_least", F.min, good), ("both_most", F.max, good))])
    counts = groups.join(counts, "gate", "left").fillna(0, ["n_nc", "n_pc"]).join(quantiles, "gate", "left")
    both = F.col("n_pc") >= min_pc
    counts = staged(counts.withColumns({c: F.when(both, F.col(f"both_{c}")).otherwise(F.col(f"nc_{c}")) for c in ("a", "b", "least", "most")}), "control-counts")
    ranges = _padded(counts.where("a IS NOT NULL").select("gate", "n_pc", "a", "b", "least", "most"), 0.02).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    use = some.where(good).join(ranges, "gate").where(nc | both)
    ranges = ranges.drop("n_pc")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")
    hist = use.where("x >= lo AND x <= hi").groupBy("gate", at).agg(F.count_if(nc).alias("nc"), F.count_if(~nc).alias("pc"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(hist, ["gate", "bin"], "left").fillna(0, ["nc", "pc"])
    grid = grid.withColumns({"s_nc": smoothed(F.col("nc"), ["gate"], width=smooth), "s_pc": smoothed(F.col("pc"), ["gate"], width=smooth)})
    all_bins, by_bin = Window.partitionBy("gate"), Window.partitionBy("gate").orderBy("bin")
    grid = grid.withColumns({
        "peak": F.max("s_nc").over(all_bins),
        "peak_bin": F.max(F.struct(F.col("s_nc"), (-F.col("bin")).alias("minus"))).over(all_bins)["minus"] * -1,
        "d_nc": F.col("s_nc") / F.greatest(F.lit(1.0), F.sum("s_nc").over(all_bins)),
        "d_pc": F.col("s_pc") / F.greatest(F.lit(1.0), F.sum("s_pc").over(all_bins)),
    })
    low = ((F.col("s_nc") <= tail * F.col("peak")) & (F.col("bin") > F.col("peak_bin"))).cast("int")
    grid = grid.withColumn("in_run", F.sum(low).over(by_bin.rowsBetween(1 - run, 0)) == run)
    crosses = (F.col("bin") > F.col("peak_bin")) & (F.col("bin") < bins - 1) & (F.col("d_pc") >= F.col("d_nc")) & (F.col("s_nc") <= crossing * F.col("peak"))
    found = grid.groupBy("gate", "lo", "width").agg(F.min(F.when(F.col("in_run"), F.col("bin") - run + 1)).alias("tail_bin"), F.min(F.when(crosses, F.col("bin"))).alias("cross_bin"))
    out = counts.join(found, "gate", "left")
    best = F.coalesce(F.when(both, F.col("cross_bin")), F.col("tail_bin"))
    cutoff = F.when(F.col("n_nc") >= min_nc, F.coalesce(F.col("lo") + (best + 0.5) * F.col("width"), F.col("fallback"))).otherwise(F.coalesce("fallback", F.lit(0.0)))
    return staged(out.select("gate", "nc_median_raw", "nc_median_t", "pc_median_raw", "pc_median_t", "n_nc", "n_pc", cutoff.alias("cutoff")), "controls-by-gate")
