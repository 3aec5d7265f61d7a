"""Ranking of profiles as they arrive. An extension: stateless features, then the best of all so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.schema import profile_ddl


def arriving_profiles(spark: SparkSession, path: str, signals: str = "signals") -> DataFrame:
    return spark.readStream.schema(profile_ddl(signals)).json(path)


def keep_best(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, k: int = 100) -> StreamingQuery:
    """Each batch is scored and merged with the best so far in ``out/best``; a batch that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = score(batch).select("candidate_id", "score")
        if number:
            new = new.unionByName(spark.read.parquet(f"{out}/best-{number - 1}"))
        best = new.groupBy("candidate_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "candidate_id").limit(k)
        best.write.mode("overwrite").parquet(f"{out}/best-{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """start, kind, n (and total of ``value``) of events by kind and tumbling window; in a stream rows later than the watermark are left out."""
    sums = [F.count("*").alias("n"), *([F.round(F.sum(value), 3).alias("total")] if value else [])]
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(*sums).select(F.col("w.start").alias("start"), kind, "n", *(["total"] if value else []))
