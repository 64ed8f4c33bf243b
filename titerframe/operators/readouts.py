"""Control statistics per gate and population readouts against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.numeric import finite, fluorescence_index, safe_ratio
from .statistics import control_table, exact_quantiles


def control_stats(events: DataFrame, gate: str, role: str, raw: str, t: str, **cutoff) -> DataFrame:
    """A row per gate: events and medians of both controls, and the cutoff. Missing positive controls are null."""
    return control_table(events, gate, role, raw, t, **cutoff)


def readouts(events: DataFrame, keys: list[str], gate: str, raw: str, t: str, controls: DataFrame) -> DataFrame:
    """Population metrics per keys and gate, pooled over the rows given: events, positive fraction, medians, shift, ratio, index.

    Pooling a sample's files is the same call with the sample as key: medians don't combine.
    """
    small = F.broadcast(controls.select(F.col("gate").alias("__gate"), "cutoff", "nc_median_raw", "pc_median_raw"))  # a row per gate
    joined = events.join(small, F.col(gate) == F.col("__gate"), "left")
    good = finite(F.col(raw)).isNotNull() & finite(F.col(t)).isNotNull()
    out = joined.groupBy(*keys, F.col(gate).alias("gate")).agg(
        F.count_if(good).alias("n_events"), F.count_if(good & (F.col(t) > F.col("cutoff"))).alias("n_pos"),
        A.median(F.col(raw), good).alias("median_raw"), A.median(F.col(t), good).alias("median_t"),
        F.first("nc_median_raw").alias("nc"), F.first("pc_median_raw").alias("pc"),
    )
    return _metrics(out, keys)


def readouts_of_gates(events: DataFrame, keys: list[str], gates: dict[str, Column], raw: str, t: str, controls: DataFrame, pooled: bool = False) -> DataFrame:
    """:func:`readouts` for gates that are masks over the same events: conditional aggregates, no row per gate.

    ``controls`` has a row per gate; groups without an event in a gate have no row for it. ``pooled`` says that a group may
    hold a share of all events, as a sample of many files does: its medians are then exact selections, not one task's map.
    """
    names = list(gates)
    wide = controls.agg(*[F.max(F.when(F.col("gate") == g, F.col(c))).alias(f"__{c}{i}") for i, g in enumerate(names) for c in ("cutoff", "nc_median_raw", "pc_median_raw")])
    joined = events.crossJoin(F.broadcast(wide))  # one row
    good = finite(F.col(raw)).isNotNull() & finite(F.col(t)).isNotNull()
    aggs = []
    for i, mask in enumerate(gates.values()):
        mask = F.coalesce(mask, F.lit(False))
        inside = mask & good
        medians = [] if pooled else [A.median(F.col(raw), inside).alias("median_raw"), A.median(F.col(t), inside).alias("median_t")]
        aggs.append(F.struct(
            F.lit(names[i]).alias("gate"), F.count_if(mask).alias("rows"), F.count_if(inside).alias("n_events"), F.count_if(inside & (F.col(t) > F.col(f"__cutoff{i}"))).alias("n_pos"),
            F.first(f"__nc_median_raw{i}").alias("nc"), F.first(f"__pc_median_raw{i}").alias("pc"), *medians,
        ))
    out = joined.groupBy(*keys).agg(F.array(*aggs).alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.*").where("rows > 0")
    return _metrics(out.join(_pooled_medians(events, keys, gates, raw, t, good), [*keys, "gate"], "left") if pooled else out, keys)


def _pooled_medians(events: DataFrame, keys: list[str], gates: dict[str, Column], raw: str, t: str, good: Column) -> DataFrame:
    """Medians of both values per keys and gate, by selection."""
    values = [F.struct(F.lit(g).alias("gate"), F.lit(n).alias("of"), F.when(F.coalesce(mask, F.lit(False)) & good, F.col(c)).alias("v")) for g, mask in gates.items() for n, c in (("raw", raw), ("t", t))]
    long = events.select(*keys, F.explode(F.filter(F.array(*values), lambda s: s["v"].isNotNull())).alias("m")).select(*keys, "m.*")
    found = exact_quantiles(long, [*keys, "gate", "of"], "v", [0.5])
    return found.groupBy(*keys, "gate").agg(*[F.max(F.when(F.col("of") == n, F.col("x"))).alias(f"median_{n}") for n in ("raw", "t")])


def _metrics(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(
        *keys, "gate", "n_events", F.when(F.col("n_events") > 0, F.col("n_pos") / F.when(F.col("n_events") > 0, F.col("n_events"))).otherwise(0.0).alias("pos_fraction"),
        "median_raw", "median_t", (F.col("median_raw") - F.col("nc")).alias("median_shift"),
        safe_ratio(F.col("median_raw"), F.col("nc")).alias("median_ratio"), fluorescence_index(F.col("median_raw"), F.col("nc"), F.col("pc")).alias("fluorescence_index"),
    )
