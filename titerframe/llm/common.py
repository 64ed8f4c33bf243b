"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import scratch_root

#: Characters that separate words, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written inside the innermost :func:`scratch`, per thread of control.
_WRITTEN: ContextVar[list[tuple[str, bool]] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that :func:`materialize` wrote inside, unless they were written with ``keep``."""
    outer, mine = _WRITTEN.get(), []
    token = _WRITTEN.set(mine)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path, keep in mine:
            if not keep:
                _delete(spark, path)
            elif outer is not None:
                outer.append((path, False))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str = "t", by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts lineage so that later passes neither recompute the rows nor lose them with an executor. ``by`` names
    columns that the files are partitioned by; a ``keep`` table outlives the :func:`scratch` it is written in.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append((path, keep))
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    # nothing reads this plan's shuffles again: they go with the write
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(tidy, was)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


#: Keys that are joined by broadcast at most, as the ones that hold more than this share of all rows.
HOT_KEYS, HOT_ROWS = 100_000, 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the table ``rows`` whose columns ``on`` are in ``keys``, with the columns of ``keys``.

    ``keys`` has each key once and, as ``copies``, how many rows have it. Keys of over one HOT_KEYS-th of all rows are
    fewer than HOT_KEYS, whatever the size: they alone are broadcast, so their rows stay where they are. The others meet
    by sort and merge, where no key can be large.
    """
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = F.broadcast(keys.where(F.col("copies") > most))
    if not hot.limit(1).count():
        return rows.join(keys.hint("merge"), on)
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col("copies") <= most).hint("merge"), on)
    return rows.join(hot, on).unionByName(cold)


def squeezed(text: Column) -> Column:
    """Text with every run of separators as one space, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs in ``text`` (null: 0), as a long."""
    s = squeezed(text)
    return F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    """Partitions for Python stages whose cost is CPU, not bytes; grows with the session's own shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def slices(batches, rows: int = 256):
    """Arrow batches a few rows at a time, so that what a task makes of them stays small next to the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for Python work: as it is read, unless a few files hold it all."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(parallelism(spark))
