"""Spells of time: merging, promotions, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.dates import any_date, is_current
from sieveline.operators.scan import running, spread
from sieveline.storage import stored


def merged(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching spells of a key as one: key, start, end, spells.

    A scan by range partitions: what a key has reached at the end of one is carried into the next, so a key may have any
    number of spells.
    """
    dealt = spread(df.select(*key, start, end), key, [start, end])
    seen = running(dealt, key, [start, end], reached={"__reached": F.col(end)})
    # Of equal spells that which begins an isle goes first, whatever order the second scan meets them in.
    old = F.when(F.col("__reached").isNull() | (F.col(start) > F.col("__reached")), 0).otherwise(1)
    isles = running(stored(seen.withColumn("__old", old).drop("__reached"), "spells"), key, [start, end, "__old"], total={"__isle": 1 - F.col("__old")})
    return isles.groupBy(*key, "__isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("spells")).drop("__isle")


def covered_days(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Days that a key's spells cover, overlaps once."""
    return merged(df, key, start, end).groupBy(*key).agg(F.sum(F.datediff(end, start)).cast("long").alias("covered_days"), F.count("*").alias("islands"))


def promotions(df: DataFrame, key: list[str], company: str, title: str, order: str, tie: str) -> DataFrame:
    """Changes of title within a company, oldest spell first; a key may have any number of spells."""
    narrow = df.select(*key, company, F.lower(company).alias("__company"), F.col(title).alias("__title"), F.col(order).alias("__order"), F.col(tie).alias("__tie"))
    before = F.col("__before")
    seen = running(narrow, [*key, "__company"], ["__order", "__tie"], previous={"__before": F.col("__title")})
    changed = seen.withColumn("__up", F.when(before.isNotNull() & (F.lower(before) != F.lower("__title")), 1).otherwise(0))
    return changed.groupBy(*key).agg(F.sum("__up").alias("promotions"), F.countDistinct(F.lower(company)).alias("companies"))


def trajectory(df: DataFrame, experiences: str, promotion_count: str, now: Column) -> DataFrame:
    """Adds archetype and trajectory_score.

    experiences: array of structs (title, company, industry, start_date, end_date).
    """
    start = lambda e: any_date(e["start_date"], now)
    end = lambda e: F.when(is_current(e["end_date"]), now).otherwise(F.coalesce(any_date(e["end_date"], now), now))
    dated = F.filter(experiences, lambda e: start(e).isNotNull())
    out = df.withColumn("__spans", F.transform(dated, lambda e: F.struct(start(e).alias("a"), end(e).alias("b"))))
    n = F.size(experiences)
    years = F.greatest(F.lit(0.5), F.datediff(F.array_max(F.transform("__spans", lambda s: s["b"])), F.array_min(F.transform("__spans", lambda s: s["a"]))) / 365.25)
    out = out.withColumn("__years", years)
    tenure = F.aggregate("__spans", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.08), F.datediff(s["b"], s["a"]) / 365.25)) / F.nullif(F.size("__spans"), F.lit(0))
    named = lambda f: F.array_distinct(F.filter(F.transform(experiences, lambda e: F.lower(F.trim(F.coalesce(e[f], F.lit(""))))), lambda x: x != ""))
    industries, companies = F.size(named("industry")), F.size(named("company"))
    diversity = F.least(F.lit(1.0), F.when(industries > 0, industries).otherwise(companies) / F.nullif(n, F.lit(0)))
    rate = F.col(promotion_count) / F.col("__years")
    unknown = (F.coalesce(n, F.lit(0)) <= 0) | (F.size("__spans") <= 0)
    out = out.withColumns({"mean_tenure": tenure, "promotion_rate": rate, "diversity": diversity, "__companies": companies, "__unknown": unknown})
    climbs = (F.col("promotion_rate") >= 0.45) | ((F.col("promotion_rate") >= 0.30) & (F.col("mean_tenure") >= 1.2))
    stable = F.col("mean_tenure").between(3.0, 5.5) & (F.col("diversity") <= 0.65)
    hops = (F.col("mean_tenure") < 2.0) & (F.col("diversity") >= 0.7) & (F.col("__companies") >= 3)
    kind = F.when(F.col("__unknown"), "unknown").when(climbs, "fast_climber").when(stable, "stable_performer").when(hops, "chaotic_hopper").otherwise("mixed")
    out = out.withColumn("archetype", kind)
    score = (
        F.when(F.col("archetype") == "unknown", 0.5).when(F.col("archetype") == "fast_climber", F.least(F.lit(1.0), 0.7 + F.col("promotion_rate") / 2))
        .when(F.col("archetype") == "stable_performer", 0.9).when(F.col("archetype") == "chaotic_hopper", 0.4).otherwise(0.6)
    )
    return out.withColumn("trajectory_score", score).drop("__spans", "__years", "__companies", "__unknown")
