"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are dealt into key ranges within their source, range totals are summed up per
source, and a window inside each range finishes the prefix sum of word counts. A row takes what its source's budget
leaves at its place: whole epochs first, then the head of the key order up to the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, table, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source, and so each of its documents, is read at most so many times.
MAX_EPOCHS = 3
#: Key ranges per source; they bound a window's group to this share of the largest source.
RANGES_HEX = 3


def _random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Hash of the id; of the text where there is no id."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Word targets of sources; ``sources`` has src_key, source, source_size (a row per source).

    Targets are weight shares of all words; one that exceeds ``max_epochs`` times its source stops there and the
    excess goes to the others by weight. Sorted by the ratio at which they fill up, the capped sources are a prefix,
    so one pass of running sums finds the level.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(ws, ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    s = s.withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"])
    return s.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("src_key", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", carry: bool = False) -> DataFrame:
    """Words that a mixture takes of every document.

    Returns ``id_col``, size, source_size, target, taken; with ``carry`` also __row, a struct of all columns of
    ``docs``. ``taken`` counts repeats: each source's rows add up to its target, rounded to a word.

    Null text has size 0; null ids are keyed by their texts; a null source is a source, last in order. Repeated rows count each.
    Rows of equal key are ordered by id and size. An empty table gives no rows.
    """
    names = [id_col, "size", "source_size", "target", "taken"]
    keep = ["__row"] * carry
    rows = docs.select(
        F.col(id_col), *[F.struct(*docs.columns).alias("__row")] * carry, word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__src"), F.col(source_col).cast("string").alias("__source"),
        _random_key(F.col(id_col), F.col(text_col).cast("string"), seed).alias("__key"),
    ).withColumn("__range", F.substring("__key", 1, RANGES_HEX))
    rows = materialize(rows, "mix-rows")

    ranges = rows.groupBy(F.col("__src").alias("src_key"), F.col("__range").alias("range")).agg(F.first("__source").alias("source"), F.sum("size").alias("range_size"))
    ranges = materialize(ranges, "mix-ranges")
    targets = source_targets(ranges.groupBy("src_key").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")), weights, max_epochs)
    up_to = Window.partitionBy("src_key").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("range_size").over(up_to) - F.col("range_size")).join(targets, "src_key").select("src_key", "range", "before", "source_size", "target")

    in_range = Window.partitionBy("__src", "__range").orderBy("__key", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(ranges, (F.col("__src") == F.col("src_key")) & (F.col("__range") == F.col("range")))
    out = out.withColumn("__before", F.col("before") + F.sum("size").over(in_range) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    head = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    return out.withColumn("taken", epochs * F.col("size") + head).select(*names, *keep)


def take_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text``, joined by single spaces."""
    return F.concat_ws(" ", F.slice(F.split(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+"), F.lit(1), n.cast("int")))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as taken, the one cut document of a source by its head.

    A document taken k times whole gives k rows; a rest below its size gives one more row with that many words.
    Documents of which nothing is taken go, so do null, empty and blank texts. Column set and order are those of ``docs``,
    whatever they are called; repeated rows are taken each; an empty table stays empty.
    """
    text = options.get("text_col", "text")
    mixed = mix(docs, carry=True, **options).where("taken > 0")
    mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rest = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    whole = F.col("__row")[text]
    new = {c: F.col("__row")[c] for c in docs.columns} | {text: F.when(rest < F.col("size"), take_words(whole, rest)).otherwise(whole)}
    return mixed.select(*[new[c].alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap
  FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), v AS (
  SELECT arg_min(level, cap / weight) AS level FROM l WHERE level <= cap / weight
), t AS (
  SELECT source, source_size, least(cap, v.level * weight) AS target FROM w, v
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM r
"""
