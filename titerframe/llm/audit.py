"""Interaction audit of filters: what every filter removes, and for whom, in every order of applying them.

Each document's failed filters are one bit mask. Documents are crossed with the orders (120 rows for five filters, so
broadcast), the first failing step of each pair is computed, the steps are exploded and counted at once: counts are
combined before the shuffle, which carries a row per part, order, step and task.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_ROWS, materialize, slices, spread, table

FILTERS = "ABCDE"
#: Limits of the filters A, B and C, and the characters of D. Fixed values of the query.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")

#: Words are runs of what ``bytes.split`` does not split at; long texts are read a word at a time.
_WORD, _LONG = re.compile(rb"[^\x20\x09-\x0D]+"), 1 << 20
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_flags(text: bytes) -> int:
    """Bit mask of the filters A to D that the UTF-8 text fails."""
    n, distinct = 0, set()
    for part in [text.split()] if len(text) <= _LONG else map(lambda m: (m[0],), _WORD.finditer(text)):
        n += len(part)
        distinct.update(part)
    few = n < MIN_WORDS
    same = 100 * len(distinct) < MIN_DISTINCT_PERCENT * n
    capitals = 100 * len(text.translate(None, _NOT_CAPITAL)) > MAX_CAPITALS_PERCENT * len(text.translate(None, _CONTINUATION))
    return few | same << 1 | capitals << 2 | bool(SYMBOLS.search(text)) << 3


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and mask of every document; bit k of the mask is set if it fails filter k of A to E.

    E is failed by a text that a smaller id has too: ids of equal texts (by sha256) meet their minimum, in a table of
    repeated texts only. Texts that hold more than a bounded share of all rows meet it by broadcast, so that their rows
    stay where they are. Rows of the minimum pass, so do rows without an id. A null text is an empty one, a null part the
    empty string.
    """

    def run(batches):
        for batch in slices(batches, 1024):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            masks, digests = pa.array([text_flags(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["id", "part", "mask", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    given = spread(docs.select(id_col, part_col, text_col)).select(F.col(id_col).alias("id"), part.alias("part"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = materialize(given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, part string, mask int, digest binary"), "audit-flags")
    repeated = rows.groupBy("digest").agg(F.min("id").alias("__first"), F.count("*").alias("__copies")).where("__copies > 1")
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    often = F.broadcast(repeated.where(F.col("__copies") > most).drop("__copies"))  # fewer than HOT_KEYS texts
    seldom = repeated.where(F.col("__copies") <= most).drop("__copies").hint("merge")
    met = rows.join(often, "digest").unionByName(rows.join(often, "digest", "left_anti").join(seldom, "digest", "left"))
    later = F.coalesce(F.col("id") > F.col("__first"), F.lit(False))
    return met.select("id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts per part, order of the filters and step; ``flags`` has part, mask, good and bad (booleans), a row a document.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, bad_lost, and shapley: what the
    step's filter removes, summed over all orders. Every part has a row per order and step. No rows give none.
    """
    spark = flags.sparkSession
    n = len(filters)
    places = list(itertools.permutations(range(n)))
    orders = spark.range(1).select(F.posexplode(F.array(*[F.array(*map(F.lit, p)) for p in places])).alias("order", "places"))
    fails: Column = F.getbit("mask", F.element_at("places", F.col("step")))
    first = F.coalesce(*[F.when(F.getbit("mask", F.col("places")[k]) == 1, k + 1) for k in range(n)], F.lit(n + 1))
    rows = flags.crossJoin(F.broadcast(orders)).withColumn("first", first)
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(n)])))
    removed = F.col("first") == F.col("step")
    counted = rows.groupBy("part", "order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((fails == 1) & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if((fails == 1) & (F.bit_count("mask") == 1)).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("bad")).alias("bad_lost"),
    )
    names = F.array(*[F.lit("".join(filters[i] for i in p)) for p in places])
    counted = counted.withColumn("filter_order", F.element_at(names, F.col("order") + 1)).withColumn("__filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    counted = counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "__filter")))
    return counted.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "bad_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """The audit of the five filters over ``docs``; see :func:`document_flags` and :func:`replay`.

    A document is good (bad) if a row of ``labels`` with its id says 1; ids that ``labels`` lacks and null ids are
    neither, repeated label rows count once. Repeated documents count each. An empty table gives no rows; other columns
    are not read.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in ((good_col, "good"), (bad_col, "bad"))])
    flags = document_flags(docs, id_col, text_col, part_col).join(known, "id", "left")
    return replay(flags.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "bad")]))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("bad_lost", "toxic_lost")


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM t LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, good, bad, count(*) AS n, [f.A, f.B, f.C, f.D, f.E] AS fails FROM f GROUP BY ALL
), x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS places, substr('ABCDE', a.i, 1) || substr('ABCDE', b.i, 1) || substr('ABCDE', c.i, 1) || substr('ABCDE', d.i, 1) || substr('ABCDE', e.i, 1) AS filter_order
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), r AS (
  SELECT part, filter_order, s.i AS step, good, bad, n, places[s.i] AS place, fails[places[s.i]] AS failed, len(list_filter(fails, lambda v: v)) AS n_failed,
         coalesce(list_position(list_transform(places, lambda k: fails[k]), true), 6) AS first
  FROM p, o, x s
), c AS (
  SELECT part, filter_order, step, place, CAST(sum(CASE WHEN first > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN first = step THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN failed AND first < step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN first = step AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN first = step AND bad THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT * EXCLUDE (place), CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley FROM c
"""
