"""Statuses from a stream in several runs against the same over the whole table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import statuses

LOG = "job string, kind string, at timestamp, event_id long"


def log_of(n=400):
    rng = random.Random(12)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        job = "hot" if rng.random() < 0.3 else f"job{rng.randrange(25)}"
        rows.append((job, rng.choice(["enqueue", "start", "start", "finish", "error", "other"]), start + timedelta(minutes=i * 2 - rng.randrange(8)), i))
    rows += rng.sample(rows, 30) + [(None, "start", start, 9001), ("job1", "start", None, 9002), ("job1", "finish", start, None)]
    return rows


def test_stream_is_the_batch(spark, tmp_path):
    old = spark.conf.get(statuses.STATE_STORE[0], None)
    spark.conf.set(*statuses.STATE_STORE)
    try:
        rows = log_of()
        order = sorted(range(len(rows)), key=lambda i: (rows[i][2] or datetime(2024, 1, 1), i))
        parts = [order[k * len(order) // 4 : (k + 1) * len(order) // 4] for k in range(4)]
        source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
        for k, part in enumerate(parts):  # each run starts anew from the checkpoint
            spark.createDataFrame([rows[i] for i in part], LOG).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
            stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(source)
            query = statuses.follow(stream, out, checkpoint, limit_ms=20 * 60_000)
            assert query.awaitTermination(180)
            assert query.exception() is None
        whole = spark.createDataFrame(rows, LOG)
        last = max(r[2] for r in rows if r[2])
        want = {tuple(r) for r in statuses.status_of(whole, "20 minutes", F.lit(last - timedelta(minutes=10))).collect()}
        got = {tuple(r) for r in statuses.current(spark, out).collect()}
        assert got == want
        assert {s for _, s, *_ in got} >= {"stalled", "completed"}
    finally:
        if old is None:
            spark.conf.unset(statuses.STATE_STORE[0])
        else:
            spark.conf.set(statuses.STATE_STORE[0], old)


def test_stream_of_the_event_table(spark, sf, tmp_path):
    """The event table in three runs gives what the query over the whole of it gives."""
    from sieveline.plans import scaled

    old = spark.conf.get(statuses.STATE_STORE[0], None)
    spark.conf.set(*statuses.STATE_STORE)
    try:
        log = scaled.job_log(spark.read.parquet(f"{sf}/events.parquet")).toPandas().sort_values("at")
        source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
        for k in range(3):
            spark.createDataFrame(log.iloc[k * len(log) // 3 : (k + 1) * len(log) // 3], LOG).coalesce(1).write.parquet(f"{source}/{k}")
            stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(source)
            assert statuses.follow(stream, out, checkpoint, limit_ms=86_400_000).awaitTermination(180)
        got = {tuple(r) for r in statuses.current(spark, out).select("job", "status", "event_id").collect()}
        assert got == {tuple(r) for r in scaled.flt21_job_statuses(spark, sf).collect()}
    finally:
        spark.conf.unset(statuses.STATE_STORE[0]) if old is None else spark.conf.set(statuses.STATE_STORE[0], old)


@pytest.mark.parametrize("rows", [[], [(None, "start", None, None)]])
def test_nothing_to_follow(spark, rows):
    assert statuses.status_of(spark.createDataFrame(rows, LOG)).count() == 0
