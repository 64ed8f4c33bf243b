"""Progress and state of jobs, over batch tables and streams alike.

Event tables have a job, an item, a time and a value; every function takes a batch or a streaming DataFrame unless it
says otherwise. Streams need a watermark for state to be bounded: it is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(time, watermark) if df.isStreaming and watermark else df


def tumbling(df: DataFrame, keys: list[str], time: str, size: str, value: str, watermark: str | None = "1 hour") -> DataFrame:
    w = F.window(time, size)
    out = _late(df, time, watermark).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sliding(df: DataFrame, keys: list[str], time: str, size: str, step: str, value: str, watermark: str | None = "1 hour") -> DataFrame:
    w = F.window(time, size, step)
    out = _late(df, time, watermark).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, watermark: str | None = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    out = _late(df, time, watermark).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def progress(df: DataFrame, job: str, item: str, time: str) -> DataFrame:
    """Per job: events, distinct items done, last update. Exact distinct counts are for batches and small item sets."""
    return df.groupBy(job).agg(F.count("*").alias("n_events"), F.size(F.collect_set(item)).alias("n_items"), F.max(time).alias("updated_at"))


def first_of_each(df: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """Each key once: append if absent. On a stream, state is dropped behind the watermark."""
    if df.isStreaming:
        return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def expired(df: DataFrame, job: str, time: str, now: str, hours: int = 24) -> DataFrame:
    """Jobs without an update for so many hours before ``now`` (a batch operator)."""
    last = df.groupBy(job).agg(F.max(time).alias("updated_at"))
    return last.where(F.col("updated_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def evictions(jobs: DataFrame, size: str, time: str, need: int) -> DataFrame:
    """Oldest jobs first until their sizes reach ``need`` bytes. The jobs table is small: a row per job."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(size).over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return jobs.withColumn("__before", before).where(F.col("__before") < need).drop("__before")


def running_state(df: DataFrame, job: str, value: str, time: str, ttl_ms: int = 48 * 3600 * 1000) -> DataFrame:
    """Streaming counters per job (job, n, total) that are forgotten ``ttl_ms`` of event time after their last event."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            n, total = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "n": [n], "total": [total], "expired": [True]})
            return
        n, total = state.get if state.exists else (0, 0.0)
        latest = state.getCurrentWatermarkMs()
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
            latest = max(latest, int(f[time].max().timestamp() * 1000))
        state.update((n, total))
        state.setTimeoutTimestamp(latest + ttl_ms)
        yield pd.DataFrame({"job": [key[0]], "n": [n], "total": [total], "expired": [False]})

    kind = df.schema[job].dataType.simpleString()
    return df.groupBy(job).applyInPandasWithState(update, f"job {kind}, n long, total double, expired boolean", "n long, total double", "update", GroupStateTimeout.EventTimeTimeout)


def upsert(table_path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of every key in a parquet table of two alternating versions."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{table_path}/v{(batch_id - 1) % 2}") if batch_id else None
        except Exception as e:  # the first version isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(*keys, "__last.*")
        last.write.mode("overwrite").parquet(f"{table_path}/v{batch_id % 2}")

    return run


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 100) -> DataFrame:
    """A folder's parquet table as a stream, with the schema it has."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
