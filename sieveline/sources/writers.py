"""Writers: ranked CSV, reports, vectors, append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.ranking import latest


def ranked_csv(ranked: DataFrame, path: str) -> None:
    """candidate_id, rank, score with four decimals, reasoning: k rows in one file."""
    rows = ranked.orderBy("rank").select("candidate_id", "rank", F.format_string("%.4f", F.col("score").cast("double")).alias("score"), "reasoning")
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(ranked: DataFrame, path: str, lists: tuple[str, ...] = ()) -> None:
    """All columns; lists are joined by '; '."""
    ranked.select(*(F.concat_ws("; ", c).alias(c) if c in lists else F.col(c) for c in ranked.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shortlist_rows(ranked: DataFrame, least: float = 30.0) -> DataFrame:
    """Rank, name, whole score and status."""
    return ranked.select("rank", "name", F.floor(F.col("score") + 0.5).cast("int").alias("match_score"), F.when(F.floor(F.col("score") + 0.5) < least, "REJECTED").otherwise("RECOMMENDED").alias("status"))


def text_report(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row with the first k as lines of text."""
    line = F.format_string("%d. %s (%d)", "rank", "name", "match_score")
    return shortlist_rows(ranked).filter(F.col("rank") <= k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("report"))


def write_vectors(df: DataFrame, path: str) -> None:
    """Parquet of id and array<float>."""
    df.select("id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def write_baseline(ranked: DataFrame, metrics: DataFrame, job: str, path: str) -> None:
    """JSON: one record of a job with its ranking (as long as its k, in order) and the metrics of one row."""
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("top"))
    whole = rows.crossJoin(metrics.select(F.struct(*metrics.columns).alias("metrics"))).select(F.lit(job).alias("job"), "top", "metrics")
    whole.coalesce(1).write.mode("overwrite").json(path)


def audit_event(df: DataFrame, action: Column, at: Column, path: str) -> None:
    """Append JSON events with an id of their own."""
    df.select(F.uuid().alias("event_id"), at.alias("at"), action.alias("action"), *(F.col(c) for c in df.columns)).write.mode("append").json(path)


def append_version(df: DataFrame, path: str) -> None:
    """Updates are new versions: Parquet files don't change in place."""
    df.write.mode("append").parquet(path)


def current_versions(log: DataFrame, key: list[str], at: str, deleted: str | None = None, tie: str | None = None) -> DataFrame:
    """The newest version of each key (of equal times the least ``tie``), without keys whose newest version is a deletion."""
    newest = latest(log, key, [(at, True), *([(tie, False)] if tie else [])])
    return newest.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else newest


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Deletion as an anti-join rewrite."""
    return df.join(keys.select(*on), on, "left_anti")


def with_missing_columns(df: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """Adds columns that aren't there, as nulls."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ddl.items() if c not in df.columns))
