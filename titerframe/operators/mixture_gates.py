"""Gates by Gaussian mixtures per file: singlets (mixture or hybrid) and lymphocytes around a marker guide.

Models are fitted on a bounded sample of each file (a parameter) and travel back as one row a file; all events are scored
in Arrow batches. What a file decides (component, keep shares, rails) are windows over the file. Around the guide, one task
fits and scores a file whole, so events move once, by file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions import aggregates as A
from ..functions.numeric import finite, log1p_clipped
from .gates import SingletConfig, singlet_candidates, singlets_mad
from .models import fit_mixtures
from .sampling import drawn, sample_per_group

#: Rows of samples that a task holds at once, about; the sample of one file is held whole.
HELD = 60_000


@dataclass(frozen=True)
class MixtureConfig:
    sample: int = 5000
    min_events: int = 500
    components: int = 2
    tied: bool = True
    least_resp: float = 0.8
    keep: tuple[float, float] = (0.05, 0.98)
    tie: float = 0.05
    min_band_events: int = 300
    k_mad: float = 3.5
    keep_band: tuple[float, float] = (0.50, 0.999)


@dataclass(frozen=True)
class GuideConfig:
    sample: int = 80_000
    components: int = 3
    min_guide: int = 500
    min_low_fit: int = 500
    low_q: float = 0.05
    coverage: float = 0.85
    least_resp: float = 0.60
    min_keep: float = 0.02
    fsc_q: float = 0.10
    ssc_q: float = 0.99


def _flat(model, width: int = 2) -> list[float]:
    """Numbers of each component that scoring needs: log weight with the determinant, means, inverse covariance."""
    out = []
    for w, m, c in zip(*model, strict=True):
        inverse = np.linalg.inv(c)
        out += [np.log(w) - 0.5 * np.linalg.slogdet(c)[1], *m, *inverse[np.triu_indices(width)]]
    return [float(v) for v in out]


def _responsibilities(flat: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
    """Share of every component in rows of one or two columns, each from its own model flattened by ``_flat``."""
    width = x.shape[1]
    step = 1 + width + width * (width + 1) // 2
    logs = np.empty((len(x), k))
    for j in range(k):
        p = flat[:, j * step : (j + 1) * step].T
        d = [x[:, i] - p[1 + i] for i in range(width)]
        form = p[2] * d[0] * d[0] if width == 1 else p[3] * d[0] * d[0] + 2.0 * p[4] * d[0] * d[1] + p[5] * d[1] * d[1]
        logs[:, j] = p[0] - 0.5 * form
    with np.errstate(over="ignore"):
        return np.stack([1.0 / np.exp(logs - logs[:, [j]]).sum(1) for j in range(k)], 1)


def _with_responsibilities(rows: DataFrame, asked: list[tuple[str, str, int, list[str], str]]) -> DataFrame:
    """Adds responsibilities as arrays: (column, model's column, components, columns of x, mask's column) each.

    Null where the mask fails or there is no model. Arrow batches at a time: column expressions of this size are not compiled.
    """
    schema = StructType([*rows.schema.fields, *[StructField(a[0], ArrayType(DoubleType())) for a in asked]])

    def run(batches):
        for batch in batches:
            added = []
            for _, model, k, x, mask in asked:
                lists = batch.column(model)
                good = pc.fill_null(batch.column(mask), False)
                for c in (lists, *(batch.column(v) for v in x)):
                    good = pc.and_(good, c.is_valid())
                flat = lists.filter(good).flatten().to_numpy(zero_copy_only=False)
                values = np.stack([batch.column(v).filter(good).to_numpy(zero_copy_only=False) for v in x], 1)
                n, good = len(values), good.to_numpy(zero_copy_only=False)
                found = _responsibilities(flat.reshape(n, -1), k, values).ravel() if n else np.empty(0)
                ends = np.concatenate([[0], np.cumsum(good) * k]).astype(np.int32)
                added.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.float64()), mask=pa.array(~good)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return rows.mapInArrow(run, schema)


def _with_models(rows: DataFrame, file_col: str, few: DataFrame, columns: list[str], fit, names: list[str]) -> DataFrame:
    """Adds the models of every row's file as arrays. ``fit`` gives a list of models for each name from many files' columns."""
    schema = StructType([StructField("__file", rows.schema[file_col].dataType), *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def fitted(last: bool):
            """Models of the files held; one whose rows may go on is held back."""
            whole = pa.Table.from_batches(held).combine_chunks()
            codes = whole.column(file_col).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            files = len(starts) - (1 if last else 2)
            held[:] = [] if last else whole.slice(starts[files]).to_batches()
            if files:
                values = [whole.column(c).to_numpy() for c in columns]
                found = fit([[v[a:b] for v in values] for a, b in zip(starts[:files], starts[1 : files + 1], strict=True)])
                yield pa.RecordBatch.from_arrays([whole.column(file_col).take(pa.array(starts[:files])).combine_chunks(), *[pa.array(f, pa.list_(pa.float64())) for f in found]], names=schema.names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= HELD:
                    yield from fitted(False)
                    n = sum(b.num_rows for b in held)
        if held:
            yield from fitted(True)

    # a sample is dealt and sorted by file already; files come one after the other
    few = few.select(file_col, *columns).repartition(file_col).sortWithinPartitions(file_col)
    return rows.join(few.mapInArrow(run, schema), F.col(file_col).eqNullSafe(F.col("__file")), "left").drop("__file")


def _where(good: list[bool], models: list) -> list:
    """Models in the places that have one, None elsewhere."""
    found = iter(models)
    return [next(found) if g else None for g in good]


def _mixture_mask(df: DataFrame, file_col: str, row: list[str], fsc_a: str, fsc_h: str, out: str, cfg: MixtureConfig, seed: int) -> DataFrame:
    """Adds the mask ``out`` and leaves ``__valid``, ``__a`` and ``__h`` (candidates and logarithms)."""
    rows = singlet_candidates(df, file_col, fsc_a, fsc_h, SingletConfig.min_fsc_quantile)
    rows = rows.withColumns({"__a": log1p_clipped(F.col(fsc_a)), "__h": log1p_clipped(F.col(fsc_h))})
    few = sample_per_group(rows.where("__valid").select(file_col, *row, "__a", "__h", F.count("*").over(Window.partitionBy(file_col)).alias("__n")), [file_col], row, cfg.sample, seed)
    k = cfg.components

    def fit(parts: list) -> list[list]:
        good = [n[0] >= cfg.min_events and len(n) > k for *_, n in parts]
        models = fit_mixtures([np.stack(x, 1) for (*x, _), g in zip(parts, good, strict=True) if g], k, tied=cfg.tied)
        return [_where(good, [_flat(m) for m in models])]

    file, valid = Window.partitionBy(file_col), F.col("__valid")
    rows = _with_models(rows, file_col, few, ["__a", "__h", "__n"], fit, ["__model"])
    rows = _with_responsibilities(rows, [("__resp", "__model", k, ["__a", "__h"], "__valid")])
    rows = rows.withColumn("__hard", F.array_position("__resp", F.array_max("__resp")) - 1)
    facts = {}
    for j in range(k):
        mine = valid & (F.col("__hard") == j)
        a, h = F.when(mine, F.col("__a")), F.when(mine, F.col("__h"))
        turn = 0.5 * F.atan2(2.0 * F.covar_samp(a, h).over(file), F.var_samp(a).over(file) - F.var_samp(h).over(file))
        facts[f"__med{j}"] = A.median(F.col("__a"), mine).over(file)
        facts[f"__align{j}"] = F.abs(F.cos(turn) + F.sin(turn))
        facts[f"__soft{j}"] = F.avg(F.when(valid, (F.col("__resp")[j] >= cfg.least_resp).cast("int"))).over(file)
        facts[f"__share{j}"] = F.avg(F.when(valid, (F.col("__hard") == j).cast("int"))).over(file)
    rows = rows.withColumns(facts)
    best = reduce(lambda a, b: F.greatest(a, b), [F.coalesce(F.col(f"__med{j}"), F.lit(float("-inf"))) for j in range(k)])
    # of the components whose median is about the largest, the one that lies best along the diagonal
    able = [F.when(F.col(f"__med{j}") >= best - cfg.tie, F.struct(F.coalesce(finite(F.col(f"__align{j}")), F.lit(-1.0)).alias("fit"), F.lit(-j).alias("j"))) for j in range(k)]
    rows = rows.withColumn("__pick", -F.array_max(F.array(*able))["j"])
    share = lambda name: F.get(F.array(*[F.col(f"__{name}{j}") for j in range(k)]), F.col("__pick"))
    keep = (
        F.when(F.col("__model").isNull(), F.lit(True)).when(share("soft").between(*cfg.keep), F.get("__resp", F.col("__pick")) >= cfg.least_resp)
        .when(share("share").between(*cfg.keep), F.col("__hard") == F.col("__pick")).otherwise(True)
    )
    return rows.withColumn(out, valid & F.coalesce(keep, F.lit(True))).drop("__model", "__resp", "__hard", "__pick", *facts)


def singlets_mixture(df: DataFrame, file_col: str, row: list[str], fsc_a: str, fsc_h: str, out: str = "singlet", cfg: MixtureConfig = MixtureConfig(), seed: int = 0) -> DataFrame:
    """Adds a singlet column by a mixture of log area and log height per file.

    The component of the largest median area is kept, among about equal ones the best along the diagonal. Where the share
    of sure events is implausible the hard labels decide, and where theirs is too, all candidates stay; so do those of a
    file with few. Events with null or other than positive scatter are no singlets.
    """
    return _mixture_mask(df, file_col, row, fsc_a, fsc_h, out, cfg, seed).drop("__valid", "__a", "__h")


def singlets_hybrid(df: DataFrame, file_col: str, row: list[str], fsc_a: str, fsc_h: str, out: str = "singlet", cfg: MixtureConfig = MixtureConfig(), seed: int = 0) -> DataFrame:
    """Adds a singlet column by the mixture and then a narrow MAD band inside it.

    A file whose mixture keeps an implausible share gets the plain MAD gate; one whose band would have too few events,
    no spread or an implausible share keeps the mixture's events.
    """
    file, first = Window.partitionBy(file_col), F.col("__first")
    rows = singlets_mad(df, file_col, fsc_a, fsc_h, "__plain")
    rows = _mixture_mask(rows, file_col, row, fsc_a, fsc_h, "__first", cfg, seed).withColumn("__r", F.col("__h") - F.col("__a"))
    rows = rows.withColumns({"__n": F.count_if(first).over(file), "__share": F.avg(F.when(F.col("__valid"), first.cast("int"))).over(file), "__med": A.median(F.col("__r"), first).over(file)})
    rows = rows.withColumn("__mad", A.median(F.abs(F.col("__r") - F.col("__med")), first).over(file))
    band = first & F.col("__r").between(F.col("__med") - cfg.k_mad * F.col("__mad"), F.col("__med") + cfg.k_mad * F.col("__mad"))
    rows = rows.withColumn("__band", F.coalesce(band, F.lit(False))).withColumn("__kept", F.count_if("__band").over(file) / F.when(F.col("__n") > 0, F.col("__n")))
    narrow = (F.col("__n") >= cfg.min_band_events) & (F.col("__mad") > 0) & F.col("__kept").between(*cfg.keep_band)
    plausible = F.coalesce(F.col("__share").between(*cfg.keep), F.lit(False))
    rows = rows.withColumn(out, F.when(~plausible, F.col("__plain")).when(F.coalesce(narrow, F.lit(False)), F.col("__band")).otherwise(first))
    return rows.drop("__valid", "__a", "__h", "__plain", "__first", "__r", "__n", "__share", "__med", "__mad", "__band", "__kept")


def lymphocytes_guided(df: DataFrame, file_col: str, row: list[str], mask: Column, guide: Column, fsc: str, ssc: str, out: str = "lymph", cfg: GuideConfig = GuideConfig(), seed: int = 0) -> DataFrame:
    """Adds a lymphocyte column: scatter components that hold the marker-positive events, inside quantile rails.

    ``guide`` marks events positive for any lineage marker. Small ones among them leave the guide by a mixture of two on
    log forward scatter (or by quantile where that can't be fitted), unless too few would be left. Components of a scatter
    mixture are then taken in order of their share of the guide until they cover it. Few guide events, no model or an
    implausibly small share: the rails alone.
    """
    file, qc = Window.partitionBy(file_col), F.col("__qc")
    inside = mask & finite(F.col(fsc)).isNotNull() & finite(F.col(ssc)).isNotNull()
    rows = df.withColumn("__qc", F.coalesce(inside, F.lit(False))).withColumn("__guide", qc & F.coalesce(guide, F.lit(False)))
    lead = F.col("__guide")
    rows = rows.withColumns({
        "__lo": A.quantile(F.col(fsc), cfg.fsc_q, qc).over(file), "__hi": A.quantile(F.col(ssc), cfg.ssc_q, qc).over(file), "__floor": A.quantile(F.col(fsc), cfg.low_q, lead).over(file),
        "__n": F.count_if("__guide").over(file),
    })
    # in the order of the hash at any size, as the start of a mixture depends on the order of its rows
    rank = F.row_number().over(Window.partitionBy(file_col, "__qc").orderBy(F.when(qc, drawn(seed, row)), *row))
    rows = rows.select(
        *df.columns, "__qc", "__guide", "__n", log1p_clipped(F.col(fsc)).alias("__f"), log1p_clipped(F.col(ssc)).alias("__s"), (qc & (rank <= cfg.sample)).alias("__drawn"),
        F.coalesce(qc & (F.col(fsc) >= F.col("__lo")) & (F.col(ssc) <= F.col("__hi")), F.lit(False)).alias("__rails"), F.coalesce(F.col(fsc) >= F.col("__floor"), F.lit(False)).alias("__above"),
    )
    schema = StructType([*df.schema.fields, StructField(out, BooleanType())])
    names = df.columns

    def run(batches):
        held: list[pa.RecordBatch] = []
        n, enough = 0, HELD
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= enough:  # files that have ended; the last one may go on
                whole = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(whole.column(file_col))
                held = whole.slice(starts[-2]).to_batches()
                n = sum(b.num_rows for b in held)
                enough = max(HELD, 2 * n)
                if len(starts) > 2:
                    yield from gated(whole.slice(0, starts[-2]), starts[:-1])
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from gated(whole, _starts(whole.column(file_col)))

    def gated(rows: pa.Table, starts: np.ndarray):
        values = {c: rows.column(c).to_numpy() for c in ("__qc", "__guide", "__n", "__f", "__s", "__drawn", "__rails", "__above")}
        taken = _guided(values, starts, cfg)
        yield from rows.select(names).append_column(out, pa.array(taken)).to_batches()

    # the windows have dealt and sorted the events by file: files come one after the other, each whole
    return rows.sortWithinPartitions(file_col).mapInArrow(run, schema)


def _starts(files: pa.ChunkedArray) -> np.ndarray:
    """Where the files of sorted rows begin, and their end."""
    codes = files.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def _guided(rows: dict[str, np.ndarray], starts: np.ndarray, cfg: GuideConfig) -> np.ndarray:
    """The lymphocytes among the events of several files, which lie between ``starts``."""
    k, first, sizes = cfg.components, starts[:-1], np.diff(starts)
    qc, lead, x = rows["__qc"].astype(bool), rows["__guide"].astype(bool), np.stack([rows["__f"], rows["__s"]], 1)
    sampled = np.flatnonzero(rows["__drawn"].astype(bool))
    cuts = np.searchsorted(sampled, starts)
    parts = [(x[at], lead[at]) for at in (sampled[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
    good = np.array([len(v) > k and v.std(0).min() > 0 for v, _ in parts])
    some = np.array([m.sum() >= 50 and v[m, 0].std() > 0 for v, m in parts])
    models = fit_mixtures([v for (v, _), g in zip(parts, good, strict=True) if g], k)
    low = fit_mixtures([v[m, 0] for (v, m), g in zip(parts, some, strict=True) if g], 2)
    of = np.repeat(np.arange(len(sizes)), sizes)

    def responsibilities(models: list, has: np.ndarray, mask: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        resp, at = np.zeros((len(x), k)), mask & has[of]
        if models:
            flat = np.array([_flat(m, x.shape[1]) for m in models])[np.cumsum(has)[of[at]] - 1]
            resp[at] = _responsibilities(flat, k, x[at])
        return resp

    resp, small = responsibilities(models, good, qc, x, k), responsibilities(low, some, lead, x[:, :1], 2)
    n = rows["__n"][first]
    large = lead & ((n < cfg.min_low_fit)[of] | np.where(some[of], small[:, 1] >= 0.5, rows["__above"].astype(bool)))
    use = np.where((np.add.reduceat(large.astype(int), first) < cfg.min_guide)[of], lead, large)
    sums = np.add.reduceat(np.where(use[:, None], resp, 0.0), first)
    total = sums.sum(1) + 1e-12
    p = np.zeros(len(x))
    for j in range(k):  # components in order of their share, until they cover the guide
        larger = sum(np.where((sums[:, i] > sums[:, j]) | ((sums[:, i] == sums[:, j]) & (i < j)), sums[:, i], 0.0) for i in range(k) if i != j)
        p += np.where((larger / total < cfg.coverage)[of], resp[:, j], 0.0)
    inside = qc & (p >= cfg.least_resp)
    share = np.add.reduceat(inside.astype(float), first) / np.maximum(1, np.add.reduceat(qc.astype(int), first))
    rails_only = (n < cfg.min_guide) | ~good | (share < cfg.min_keep)
    return rows["__rails"].astype(bool) & (rails_only[of] | inside)
