"""Value maps and lookups: quantile mapping, intensity scaling, bit depth, prioritised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import finite
from .statistics import exact_quantiles

#: Largest value of an integer image by dtype. Fixed values.
DTYPE_MAX = {"bool": 1.0, "uint8": 255.0, "int16": 32767.0, "uint16": 65535.0}


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """``x`` through a piecewise-linear map; beyond the first and last knot their values hold. Knots are a parameter."""
    ks = sorted(knots)
    out = F.lit(float(ks[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(ks, ks[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(finite(x).isNotNull(), F.when(x <= ks[0][0], float(ks[0][1])).otherwise(out))


def quantile_knots(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Quantiles per group of any size as rows (keys, q, x), made monotone by a running maximum."""
    rows = exact_quantiles(df, keys, value, quantiles)
    return rows.withColumn("x", F.max("x").over(Window.partitionBy(*keys).orderBy("q")))


def quantile_match(df: DataFrame, keys: list[str], value: str, source: DataFrame, target: DataFrame, out: str = "mapped") -> DataFrame:
    """Values mapped so that their quantiles become the target's: knots of equal q, linear in between.

    ``source`` and ``target`` have (keys, q, x), a few rows per group; a group's knots travel as one array.
    """
    knots = source.withColumnRenamed("x", "a").join(target.withColumnRenamed("x", "b"), [*keys, "q"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("knots"))
    j = df.join(knots, keys, "left")
    x = F.col(value)
    below = F.element_at(F.filter("knots", lambda k: k["a"] <= x), -1)
    above = F.get(F.filter("knots", lambda k: k["a"] > x), F.lit(0))
    first, last = F.get("knots", F.lit(0)), F.element_at("knots", -1)
    inner = below["b"] + (x - below["a"]) / (above["a"] - below["a"]) * (above["b"] - below["b"])
    mapped = F.when(x <= first["a"], first["b"]).when(x >= last["a"], last["b"]).otherwise(inner)
    return j.withColumn(out, F.when(F.size("knots") > 0, mapped)).drop("knots")


def bit_depth(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bits that the integers of a group use, and how many low bits none of them has set."""
    v = F.col(value).cast("long")
    g = df.groupBy(*keys).agg(F.bit_or(v).alias("any"), F.max(v).alias("most"))
    bits = F.when(F.col("any") > 0, F.length(F.bin("any"))).otherwise(0)
    low = F.when(F.col("any") > 0, bits - F.length(F.regexp_replace(F.bin("any"), "0+$", ""))).otherwise(0)
    return g.withColumns({"bits": bits.cast("int"), "shift": low.cast("int")}).drop("any")


def unit_scaled(x: Column, dtype: str, white: Column | None = None) -> Column:
    """Intensity in 0..1 by dtype; floats above 1 are taken by their range, 255 or the white level given."""
    if dtype in DTYPE_MAX:
        top = F.lit(DTYPE_MAX[dtype]) if white is None else white
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / top)))
    if white is None:
        raise ValueError("float images need their largest value")
    top = F.when(white <= 1.0, 1.0).when(white <= 255.0, 255.0).otherwise(white)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / top)))


def stretched(df: DataFrame, keys: list[str], value: str, out: str = "stretched", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Percentile stretch per image for thumbnails."""
    limits = df.groupBy(*keys).agg(A.quantile(F.col(value), low).alias("__lo"), A.quantile(F.col(value), high).alias("__hi"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    s = F.coalesce((F.col(value) - F.col("__lo")) / span, F.lit(0.0))
    return df.join(limits, keys).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).drop("__lo", "__hi")


def feature_gap(df: DataFrame, group: str, real: str, synthetic: str, value: str) -> DataFrame:
    """How far a synthetic group's feature is from the real one's: median gap in real deviations, ratio, overlap of 10-90 %."""
    v = F.col(value)
    side = {"r": F.col(group) == real, "s": F.col(group) == synthetic}
    found = exact_quantiles(df.where(side["r"] | side["s"]), [group], value, [0.1, 0.5, 0.9])
    found = found.agg(*[F.max(F.when(c & (F.col("q") == q), F.col("x"))).alias(f"{k}_{n}") for n, c in side.items() for k, q in (("lo", 0.1), ("m", 0.5), ("hi", 0.9))])
    g = df.agg(*[A.sd(v, c).alias(f"sd_{n}") for n, c in side.items()]).crossJoin(F.broadcast(found))  # one row each
    shared = F.greatest(F.least("hi_r", "hi_s") - F.greatest("lo_r", "lo_s"), F.lit(0.0))
    whole = F.greatest("hi_r", "hi_s") - F.least("lo_r", "lo_s")
    return g.select(((F.col("m_s") - F.col("m_r")) / F.when(F.col("sd_r") > 0, F.col("sd_r"))).alias("z"), (F.col("m_s") / F.when(F.col("m_r") != 0, F.col("m_r"))).alias("ratio"), (shared / F.when(whole > 0, whole)).alias("overlap"))


def resolve_names(wanted: DataFrame, known: DataFrame, name: str, path: str) -> DataFrame:
    """Each wanted name's path: an exact one, else the only one with that base name; ambiguous and unknown ones are null."""
    from ..functions.text import base_name

    exact = known.select(F.col(path).alias(name), F.col(path).alias("__exact")).distinct()
    by_base = known.groupBy(base_name(F.col(path)).alias("__base")).agg(F.countDistinct(path).alias("__n"), F.min(path).alias("__only"))
    j = wanted.join(exact, name, "left").withColumn("__base", base_name(F.col(name))).join(by_base, "__base", "left")
    found = F.coalesce(F.col("__exact"), F.when(F.col("__n") == 1, F.col("__only")))
    return j.withColumn("resolved", found).withColumn("ambiguous", F.col("__exact").isNull() & F.coalesce(F.col("__n") > 1, F.lit(False))).drop("__exact", "__base", "__n", "__only")


def unlabelled_columns(wells: DataFrame, modes: DataFrame) -> DataFrame:
    """Plate columns in use without a mode, or with the mode "empty"."""
    from ..functions.numeric import well_column

    used = wells.select(well_column(F.col("well")).alias("col")).where("col IS NOT NULL").distinct()
    return used.join(modes.where("mode <> 'empty'"), "col", "left_anti")
