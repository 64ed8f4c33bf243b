"""Assay results from corrected wells: panel reactivity, crossmatch, run validity, alleles, overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import borderline, call, finite


@dataclass(frozen=True)
class AssayConfig:
    cutoff: float = 20.0
    borderline_low: float = 15.0
    borderline_high: float = 25.0
    moderate: float = 40.0
    strong: float = 70.0
    replicate_range: float = 20.0
    dynamic_range: float = 30.0
    low_rois: int = 50
    high_uncertain: float = 0.25


def overlay(wells: DataFrame, overrides: DataFrame | None, keys: list[str], value: str = "corrected", cfg: AssayConfig = AssayConfig()) -> DataFrame:
    """Adds automated_call, effective_call and manual. ``overrides``: keys and manual_call, one row a well."""
    out = wells.withColumn("automated_call", call(F.col(value), cfg.cutoff))
    if overrides is None:
        return out.withColumns({"effective_call": F.col("automated_call"), "manual": F.lit(False)})
    out = out.join(overrides.select(*keys, "manual_call"), keys, "left")
    good = F.coalesce(F.col("manual_call").isin("positive", "negative"), F.lit(False))
    return out.withColumns({"effective_call": F.when(good, F.col("manual_call")).otherwise(F.col("automated_call")), "manual": good}).drop("manual_call")


def last_overrides(history: DataFrame, keys: list[str], order: list[str], call_col: str) -> DataFrame:
    """State of an append-only history: the last entry of every key."""
    return history.groupBy(*keys).agg(F.max_by(call_col, F.struct(*order)).alias("manual_call"), F.count("*").alias("n_changes"))


def _names(condition: Column, name: str = "well") -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col(name))))


def panel_reactivity(wells: DataFrame, plate: list[str], value: str = "corrected", cfg: AssayConfig = AssayConfig()) -> DataFrame:
    """Panel reactivity per plate over wells that have a value; ``wells`` carries effective_call and manual."""
    v = finite(F.col(value))
    rows = wells.where(v.isNotNull())
    pos, neg, edge = F.col("effective_call") == "positive", F.col("effective_call") == "negative", borderline(v, cfg.borderline_low, cfg.borderline_high)
    return rows.groupBy(*plate).agg(
        F.count("*").alias("valid_wells"), F.count_if(pos).alias("positive_wells"), (100.0 * F.count_if(pos) / F.count("*")).alias("pra_percent"),
        F.avg(v).alias("mean_corrected"), A.median(v).alias("median_corrected"), F.max(v).alias("max_corrected"),
        F.count_if(pos & (v < cfg.moderate)).alias("n_weak"), F.count_if(pos & (v >= cfg.moderate) & (v < cfg.strong)).alias("n_moderate"), F.count_if(pos & (v >= cfg.strong)).alias("n_strong"),
        F.count_if(edge).alias("n_borderline"), _names(pos).alias("positive_ids"), _names(neg).alias("negative_ids"), _names(edge).alias("borderline_ids"), F.count_if("manual").alias("n_manual"),
    )


def reactivity_score(wells: DataFrame, plate: list[str]) -> DataFrame:
    """Share of positive wells among all wells of the panel, those without a result included."""
    pos, missing = F.col("effective_call") == "positive", F.col("effective_call") == "not_available"
    return wells.groupBy(*plate).agg(F.count("*").alias("total_wells"), F.count_if(pos).alias("positive_wells"), F.count_if(missing).alias("missing_wells"), (100.0 * F.count_if(pos) / F.count("*")).alias("score_percent"))


def crossmatch(wells: DataFrame, keys: list[str], value: str = "corrected", raw: str = "frac_pos_raw", cfg: AssayConfig = AssayConfig()) -> DataFrame:
    """Crossmatch result per group of replicate wells.

    Without overrides the call is that of the mean; with any, the majority of effective calls, ties going to the
    manual ones' majority and then to the mean. A wide replicate range flags, but doesn't decide.
    """
    v = finite(F.col(value))
    pos, neg = F.col("effective_call") == "positive", F.col("effective_call") == "negative"
    g = wells.groupBy(*keys).agg(
        F.avg(v).alias("mean_corrected"), A.mean(F.col(raw)).alias("mean_raw"), A.sd(v).alias("replicate_sd"), A.spread(v).alias("replicate_range"), F.count("*").alias("n_wells"),
        F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.count_if("manual").alias("n_manual"),
        F.count_if(pos & F.col("manual")).alias("m_pos"), F.count_if(neg & F.col("manual")).alias("m_neg"), F.count_if(borderline(v, cfg.borderline_low, cfg.borderline_high)).alias("n_borderline"),
    )
    by_mean = call(F.col("mean_corrected"), cfg.cutoff)
    voted = (
        F.when(F.col("n_pos") > F.col("n_neg"), "positive").when(F.col("n_neg") > F.col("n_pos"), "negative")
        .when(F.col("m_pos") > F.col("m_neg"), "positive").when(F.col("m_neg") > F.col("m_pos"), "negative").otherwise(by_mean)
    )
    use_votes = (F.col("n_manual") > 0) & (F.col("n_pos") + F.col("n_neg") > 0)
    return g.select(
        *keys, "n_wells", F.when(use_votes, voted).otherwise(by_mean).alias("final_call"), F.when(use_votes, "effective_well_calls").otherwise("measured_mean").alias("call_source"),
        "mean_corrected", "mean_raw", (F.col("mean_corrected") - cfg.cutoff).alias("margin"), "replicate_sd", "replicate_range",
        F.coalesce(F.col("replicate_range") > cfg.replicate_range, F.lit(False)).alias("discordant"), borderline(F.col("mean_corrected"), cfg.borderline_low, cfg.borderline_high).alias("borderline"), "n_borderline", "n_manual",
    )


def crossmatch_by_mode(wells: DataFrame, mode: str, **options) -> DataFrame:
    """The result for every cell mode and for all wells together (mode null)."""
    each = crossmatch(wells, [mode], **options)
    return each.unionByName(crossmatch(wells.withColumn(mode, F.lit(None).cast("string")), [mode], **options))


def run_validity(wells: DataFrame, plate: list[str], raw: str = "frac_pos_raw", cfg: AssayConfig = AssayConfig()) -> DataFrame:
    """Control checks per plate; any warning makes a run invalid, QC remarks on wells make it one with warnings."""
    pc, nc = F.col("role") == "positive", F.col("role") == "negative"
    v = F.col(raw)
    g = wells.groupBy(*plate).agg(
        A.mean(v, pc).alias("pc_mean"), A.mean(v, nc).alias("nc_mean"), A.spread(F.when(pc, v)).alias("pc_range"), A.spread(F.when(nc, v)).alias("nc_range"), F.count_if(pc).alias("n_pc"), F.count_if(nc).alias("n_nc"),
        F.count_if(F.col("n_rois") < cfg.low_rois).alias("n_low_roi"), F.count_if(F.col("frac_uncertain") > cfg.high_uncertain).alias("n_high_uncertain"),
    ).withColumn("dynamic_range", F.col("pc_mean") - F.col("nc_mean"))
    warnings = F.array_compact(F.array(
        F.when(F.col("n_pc") == 0, "no positive control"), F.when(F.col("n_nc") == 0, "no negative control"),
        F.when(F.coalesce(F.col("dynamic_range") < cfg.dynamic_range, F.lit(True)), "poor separation"),
        F.when(F.col("pc_range") > cfg.replicate_range, "positive controls differ"), F.when(F.col("nc_range") > cfg.replicate_range, "negative controls differ"),
    ))
    g = g.withColumn("warnings", warnings)
    status = F.when(F.size("warnings") > 0, "invalid").when(F.col("n_low_roi") + F.col("n_high_uncertain") > 0, "warning").otherwise("valid")
    return g.withColumn("status", status)


def allele_evidence(layout: DataFrame, wells: DataFrame, plate: list[str]) -> DataFrame:
    """Reactivity of every allele over the wells that carry it: counts, well lists, fraction and ratio text.

    ``layout``: well, locus, allele, each once; ``wells``: plate columns, well, effective_call, corrected. Wells without
    a result count as carriers and are listed as missing. The layout is a small dimension of the plate format.
    """
    plates = wells.select(*plate).distinct() if plate else None
    carriers = layout.crossJoin(F.broadcast(plates)) if plate else layout  # a row per plate, format sized
    joined = carriers.join(wells.select(*plate, "well", "effective_call", "corrected"), [*plate, "well"], "left")
    pos, neg = F.col("effective_call") == "positive", F.col("effective_call") == "negative"
    missing = F.col("effective_call").isNull() | (F.col("effective_call") == "not_available")
    out = joined.groupBy(*plate, "locus", "allele").agg(
        F.count("*").alias("total"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), _names(pos).alias("positive_ids"), _names(neg).alias("negative_ids"), _names(missing).alias("missing_ids"),
    )
    return out.withColumns({"fraction": F.col("n_pos") / F.col("total"), "ratio": F.concat_ws("/", "n_pos", "total")})


def top_alleles_by(evidence: DataFrame, keys: list[str], n: int = 35) -> DataFrame:
    """The report's list of every group: by fraction, count and carriers; ties by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("fraction"), F.desc("n_pos"), F.desc("total"), "locus", "allele")
    return evidence.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def top_alleles(evidence: DataFrame, n: int = 35) -> DataFrame:
    """The report's list: by fraction, count and carriers; ties by name."""
    return evidence.orderBy(F.desc("fraction"), F.desc("n_pos"), F.desc("total"), "locus", "allele").limit(n)


def plate_matrix(wells: DataFrame, keys: list[str], value: str, columns: int = 10) -> DataFrame:
    """A row per plate row, a column per plate column."""
    cells = wells.select(*keys, F.substring("well", 1, 1).alias("row"), F.regexp_extract("well", r"(\d+)$", 1).cast("int").alias("col"), value)
    return cells.groupBy(*keys, "row").pivot("col", list(range(1, columns + 1))).agg(F.first(value, ignorenulls=True))


def role_counts(wells: DataFrame, plate: list[str]) -> DataFrame:
    pos = F.col("effective_call") == "positive"
    return wells.groupBy(*plate, F.lower("role").alias("role")).agg(F.count("*").alias("n_wells"), F.count_if(pos).alias("n_positive"))


def acquisition_order(wells: DataFrame, plate: list[str], well: str = "well") -> DataFrame:
    """Snake scan order of wells by column: down the first column, up the second, and so on."""
    letter, col = F.ascii(F.substring(well, 1, 1)), F.regexp_extract(well, r"(\d+)$", 1).cast("int")
    order = Window.partitionBy(*plate).orderBy(col, F.when(col % 2 == 1, letter).otherwise(-letter))
    return wells.withColumn("scan", F.row_number().over(order))
