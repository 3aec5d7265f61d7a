"""The status of ranking jobs, kept from a growing log of audit events.

Each job's state is its newest event, by time, then id. An event that comes late (but within the watermark) and is older changes nothing, and
neither does one that comes again. A job that is at work sets a timer; if no event follows within ``limit`` of event time, the job counts as stalled
until one does. ``status_of`` is the same over a table.

Cases: events without a job, a time or an id are left out; later than the watermark, events are dropped; kinds that aren't known leave the
status ``unknown``; equal times go by the larger id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sieveline.shipping import ship

# What an event says of its job.
STATUSES = {"enqueue": "pending", "start": "processing", "finish": "completed", "error": "failed"}
AT_WORK = ("pending", "processing")
STALLED, UNKNOWN = "stalled", "unknown"
OUT = "job string, status string, at timestamp, event_id long"
#: What Spark needs to keep such state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def status_column(kind: Column) -> Column:
    out = F.lit(UNKNOWN)
    for name, status in STATUSES.items():
        out = F.when(kind == name, status).otherwise(out)
    return out


def events_of(log: DataFrame) -> DataFrame:
    """job, kind, at, event_id of the events that can count."""
    return log.select(F.col("job").cast("string").alias("job"), "kind", F.col("at").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("event_id")).dropna(subset=["job", "at", "event_id"])


def status_of(log: DataFrame, limit: str = "1 hour", until: Column | None = None) -> DataFrame:
    """job, status, at, event_id over a table; until: the time at which a job at work counts as stalled if its last event is ``limit`` older."""
    newest = events_of(log).groupBy("job").agg(F.max(F.struct("at", "event_id", "kind")).alias("e")).select("job", status_column(F.col("e.kind")).alias("status"), "e.at", "e.event_id")
    if until is None:
        return newest
    late = F.col("status").isin(*AT_WORK) & (F.col("at") + F.expr(f"INTERVAL {limit}") <= until)
    return newest.withColumn("status", F.when(late, STALLED).otherwise(F.col("status")))


class JobStatus(StatefulProcessor):
    """A job's newest event, and a timer while it is at work."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long, event_id long, status string")

    @staticmethod
    def _row(key, ms: int, event_id: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "status": [status], "at": [pd.Timestamp(ms, unit="us")], "event_id": [event_id]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.newest.get() if self.newest.exists() else None
        best = (old[0], old[1], old[2]) if old else None
        for frame in rows:
            for us, event_id, kind in zip(frame["us"], frame["event_id"], frame["kind"], strict=True):
                if best is None or (us, event_id) > best[:2]:
                    best = (int(us), int(event_id), STATUSES.get(kind, UNKNOWN))
        if best is None or old and best[:2] == (old[0], old[1]):
            return
        self.newest.update(best)
        if best[2] in AT_WORK:
            self.handle.registerTimer(best[0] // 1000 + self.limit_ms)
        yield self._row(key, *best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.newest.exists():
            return
        ms, event_id, status = self.newest.get()
        # A timer of an event that others have followed says nothing.
        if status in AT_WORK and ms // 1000 + self.limit_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.update((ms, event_id, STALLED))
            yield self._row(key, ms, event_id, STALLED)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, out: str, checkpoint: str, limit_ms: int = 3_600_000, late: str = "10 minutes") -> StreamingQuery:
    """Writes each change of a status below ``out``, by batch: a batch that runs again replaces its own. Set ``STATE_STORE`` in the session."""
    ship(stream.sparkSession)
    rows = events_of(stream).withWatermark("at", late).select("job", "kind", "at", "event_id", F.unix_micros("at").alias("us"))
    changes = rows.groupBy("job").transformWithStateInPandas(JobStatus(limit_ms), OUT, "Update", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, out: str) -> DataFrame:
    """job, status, at, event_id: the last change of each job."""
    every = spark.read.schema(f"{OUT}, batch long").parquet(f"{out}/batch-*")
    stalled = (F.col("status") == STALLED).cast("int")
    newest = every.groupBy("job").agg(F.max(F.struct("at", "event_id", "batch", stalled.alias("s"), "status")).alias("e"))
    return newest.select("job", "e.status", "e.at", "e.event_id")
