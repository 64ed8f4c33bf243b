"""Merged state of jobs on streams, with expiry by timers, and callbacks on progress.

Needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to :data:`ROCKSDB`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Jobs are forgotten so long after their last update.
TTL_MS = 48 * 3600 * 1000


class _Merge(StatefulProcessor):
    """Per job the latest value of every field, in a map state; the time of the last update in a value state."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "value string, at long")
        self.last = handle.getValueState("last", "at long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, n = (self.last.get() if self.last.exists() else (0, 0))
        for frame in rows:
            for field, value, when in zip(frame["field"], frame["value"], frame["at"], strict=True):
                when = int(pd.Timestamp(when).timestamp() * 1000)
                n, at = n + 1, max(at, when)
                known = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
                # the later write wins, of equally late ones the larger value: the order of arrival does not matter
                if known is None or (when, value or "") >= (known[1], known[0] or ""):
                    self.fields.updateValue((field,), (value, when))
        self.last.update((at, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.ttl_ms)
        yield self._row(key, n, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, n = self.last.get() if self.last.exists() else (0, 0)
        yield self._row(key, n, at, True)
        self.fields.clear()
        self.last.clear()

    def _row(self, key, n: int, at: int, expired: bool) -> pd.DataFrame:
        state = {k[0]: v[0] for k, v in self.fields.iterator()}
        return pd.DataFrame({"job": [key[0]], "n_updates": [n], "updated_ms": [at], "fields": [dict(sorted(state.items()))], "expired": [expired]})

    def close(self) -> None:
        pass


def merged_state(updates: DataFrame, job: str, field: str, value: str, time: str, watermark: str = "0 seconds", ttl_ms: int = TTL_MS) -> DataFrame:
    """Merged fields of every job on a stream of (job, field, value, time): job, n_updates, updated_ms, fields, expired.

    Every update of a job gives its whole state; a field has the value that was written last by event time, however the
    updates arrive. ``ttl_ms`` of event time after its last update a job is given once more, with ``expired``, and
    forgotten. Null fields are left out; a null value overwrites.
    """
    kind = updates.schema[job].dataType.simpleString()
    rows = updates.where(F.col(field).isNotNull() & F.col(time).isNotNull()).select(F.col(job).alias("job"), F.col(field).cast("string").alias("field"), F.col(value).cast("string").alias("value"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", watermark)
    return rows.groupBy("job").transformWithStateInPandas(
        _Merge(ttl_ms), f"job {kind}, n_updates long, updated_ms long, fields map<string,string>, expired boolean", "Update", "EventTime"
    )


def merged_table(updates: DataFrame, job: str, field: str, value: str, time: str) -> DataFrame:
    """The same state of a batch table: job, n_updates, updated_ms, fields (sorted by name)."""
    rows = updates.where(F.col(field).isNotNull() & F.col(time).isNotNull())
    at = F.unix_millis(F.col(time).cast("timestamp"))
    last = rows.groupBy(job, field).agg(F.max_by(F.col(value).cast("string"), F.struct(at, F.coalesce(F.col(value).cast("string"), F.lit("")))).alias("v"), F.count("*").alias("n"), F.max(at).alias("at"))
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(field).cast("string"), F.col("v")))))
    return last.groupBy(F.col(job).alias("job")).agg(F.sum("n").alias("n_updates"), F.max("at").alias("updated_ms"), fields.alias("fields"))


class Progress(StreamingQueryListener):
    """Tells a callback what queries do: {"stage", "query", "batch", "rows", "state_rows"}."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"stage": "started", "query": event.name, "batch": None, "rows": 0, "state_rows": 0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"stage": "progress", "query": p.name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"stage": "failed" if event.exception else "ended", "query": None, "batch": None, "rows": 0, "state_rows": 0})


def listen(spark: SparkSession, tell: Callable[[dict], None]) -> Progress:
    """Start telling; ``spark.streams.removeListener`` ends it."""
    listener = Progress(tell)
    spark.streams.addListener(listener)
    return listener
