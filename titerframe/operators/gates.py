"""Event gates as boolean columns and per-file limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import TINY, asinh_t, finite, log1p_clipped


@dataclass(frozen=True)
class SingletConfig:
    min_fsc_quantile: float = 0.02
    min_events: int = 300
    k_mad: float = 4.0
    min_ratio_events: int = 100


def drop_not_finite(df: DataFrame, channels: list[str]) -> DataFrame:
    """Rows without NaN, null or infinity in any of the channels."""
    return df.where(reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() for c in channels]))


def clip_range(x: Column, limit: Column | float) -> Column:
    return F.when(x.isNotNull(), F.least(x, limit if isinstance(limit, Column) else F.lit(float(limit))))


def edge_gate(channels: list[str], pnr: Column | float, png: Column | float = 1.0, hi_frac: float = 0.95) -> Column:
    """All channels strictly between 0 and ``hi_frac`` of the channel's limit."""
    top = hi_frac * ((pnr if isinstance(pnr, Column) else F.lit(float(pnr))) / (png if isinstance(png, Column) else F.lit(float(png))))
    inside = [(finite(F.col(c)) > 0.0) & (F.col(c) < top) for c in channels]
    return F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))


def singlet_candidates(df: DataFrame, file_col: str, fsc_a: str, fsc_h: str, min_quantile: float) -> DataFrame:
    """Adds ``__valid``: positive area and height, and an area not among the file's smallest. Events move once, by file."""
    positive = (finite(F.col(fsc_a)) > TINY) & (finite(F.col(fsc_h)) > TINY)
    rows = df.withColumn("__cut", A.quantile(F.col(fsc_a), min_quantile, positive).over(Window.partitionBy(file_col)))
    return rows.withColumn("__valid", F.coalesce(positive & (F.col(fsc_a) >= F.col("__cut")), F.lit(False))).drop("__cut")


def singlets_mad(df: DataFrame, file_col: str, fsc_a: str, fsc_h: str, out: str = "singlet", cfg: SingletConfig = SingletConfig()) -> DataFrame:
    """Adds a singlet column: a MAD band on log height minus log area, per file.

    Candidates are positive and not among the smallest areas. A file of few candidates, or whose ratio doesn't vary,
    keeps all of them. Events move once, by file; the file's order statistics are windows over it.
    """
    file = Window.partitionBy(file_col)
    rows = singlet_candidates(df, file_col, fsc_a, fsc_h, cfg.min_fsc_quantile)
    rows = rows.withColumn("__r", log1p_clipped(F.col(fsc_h)) - log1p_clipped(F.col(fsc_a)))
    rows = rows.withColumns({"__med": A.median(F.col("__r"), F.col("__valid")).over(file), "__n": F.count_if("__valid").over(file)})
    rows = rows.withColumn("__mad", A.median(F.abs(F.col("__r") - F.col("__med")), F.col("__valid")).over(file))
    inside = F.col("__r").between(F.col("__med") - cfg.k_mad * F.col("__mad"), F.col("__med") + cfg.k_mad * F.col("__mad"))
    all_valid = (F.col("__n") < max(cfg.min_events, cfg.min_ratio_events)) | (F.col("__mad") <= 0)
    return rows.withColumn(out, F.col("__valid") & F.coalesce(all_valid | inside, F.lit(False))).drop("__valid", "__r", "__med", "__mad", "__n")


def lymphocyte_rails(df: DataFrame, file_col: str, mask: Column, fsc: str, ssc: str, low_q: float = 0.10, high_q: float = 0.99, out: str = "lymph") -> DataFrame:
    """Quantile rails inside ``mask``: scatter not among the smallest, granularity not among the largest."""
    rails = df.where(mask).groupBy(file_col).agg(A.quantile(F.col(fsc), low_q).alias("__lo"), A.quantile(F.col(ssc), high_q).alias("__hi"))
    rows = df.join(rails, file_col, "left")
    return rows.withColumn(out, F.coalesce(mask & (F.col(fsc) >= F.col("__lo")) & (F.col(ssc) <= F.col("__hi")), F.lit(False))).drop("__lo", "__hi")


def marker_positive(x: Column, cofactor: float, threshold: Column | float) -> Column:
    return F.coalesce(asinh_t(finite(x), cofactor) > threshold, F.lit(False))


def explode_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """A row for every event and gate it is in; for few gates prefer conditional aggregates over this."""
    structs = [F.struct(F.lit(name).alias("gate"), F.coalesce(mask, F.lit(False)).alias("__in")) for name, mask in gates.items()]
    return df.withColumn("__g", F.explode(F.array(*structs))).where("__g.__in").withColumn("gate", F.col("__g.gate")).drop("__g")


def outlier_threshold(df: DataFrame, keys: list[str], score: str, q: float = 0.99) -> DataFrame:
    """Quantile of training scores; infinite where there are none."""
    from .statistics import exact_quantiles

    found = exact_quantiles(df, keys, score, [q]).select(*keys, F.col("x").alias("threshold"))
    if not keys:
        return found.agg(F.coalesce(F.max("threshold"), F.lit(float("inf"))).alias("threshold"))
    groups = df.select(*keys).distinct().join(found, keys, "left")
    return groups.select(*keys, F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))


def coverage_prefix(df: DataFrame, keys: list[str], order: list, share: str, target: float = 0.85) -> DataFrame:
    """Rows in order until their running share reaches the target; the one that reaches it included."""
    before = F.coalesce(F.sum(share).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("__before", before).where(F.col("__before") < target).drop("__before")
