"""The pool ranking: eleven features, a linear score or a model's, packed results and roll-ups."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions import text as tx
from sieveline.functions.numbers import clip, or_else, sigmoid, weighted
from sieveline.operators.features import months_worked, quality_score, reliability, startup_readiness, with_texts
from sieveline.operators.ranking import rank_top, top, with_min_max
from sieveline.schema import JobSpec
from sieveline.shipping import ship

MODEL_COLUMNS = (
    "semantic_sim", "bm25_score", "title_similarity", "skill_coverage", "seniority_alignment", "anti_skill_penalty",
    "keyword_stuffing_risk", "quality_score", "hireability_score", "startup_readiness_score", "behavioral_reliability_score",
)


def anti_skill_penalty(anti: Mapping[str, float] = specs.ANTI_SKILLS) -> Column:
    """For each spell and each foreign term in its title, description or the skills: weight by time, summed, clipped.

    A term in the skills counts once for every spell.
    """

    def time(j: Column) -> Column:
        return F.least(F.greatest(or_else(j["duration_months"], 0), F.lit(6)) / 24.0, F.lit(1.0))

    def weight(j: Column) -> Column:
        out = F.lit(0.0)
        for term, w in anti.items():
            has = F.contains(tx.low(j["title"]), F.lit(term)) | F.contains(tx.low(j["description"]), F.lit(term)) | F.contains(F.col("skills_text"), F.lit(term))
            out = out + F.when(has, w).otherwise(0.0)
        return out

    return clip(F.aggregate("__career", F.lit(0.0), lambda s, j: s + weight(j) * time(j)))


def pool_features(df: DataFrame, spec: JobSpec = specs.POOL_SEARCH, signals: str = "signals", anti: Mapping[str, float] = specs.ANTI_SKILLS) -> DataFrame:
    """Features with proxies for similarity; ``with_real_scores`` replaces those."""
    out = with_texts(df, signals) if "__skills" not in df.columns else df
    first = tx.low(F.get("__career", F.lit(0))["title"])
    seen = F.concat_ws(" ", "skills_text", tx.low(F.get("__career", F.lit(0))["description"]))
    s = lambda c, d: or_else(f"__signals.{c}", d)
    friction = sigmoid(s("notice_period_days", 90), 0.1, 30)
    out = out.withColumn("current_title", first).withColumns({
        "semantic_sim": tx.hits_in(seen, spec.keywords) / float(max(len(spec.keywords), 1)),
        "title_similarity": F.least(tx.hits_in(first, spec.title_terms) / 2.0, F.lit(1.0)),
        "skill_coverage": tx.hits_in(F.col("skills_text"), spec.req_skills) / float(max(len(spec.req_skills), 1)),
        "seniority_alignment": F.greatest(F.lit(0.0), 1 - F.abs(months_worked() / 12.0 - spec.seniority_years) / 10.0),
        "anti_skill_penalty": anti_skill_penalty(anti),
        "quality_score": quality_score(),
        "hireability_score": 0.5 * s("recruiter_response_rate", 0.0) + F.when(s("open_to_work_flag", False), 0.2).otherwise(0.0) + 0.3 * (1 - friction),
        "startup_readiness_score": startup_readiness(spec.consulting),
        "behavioral_reliability_score": reliability(),
    })
    return stuffing(out.withColumn("bm25_score", F.col("semantic_sim")))


def stuffing(df: DataFrame) -> DataFrame:
    return df.withColumn("keyword_stuffing_risk", F.when((F.col("bm25_score") > 0.6) & (F.col("title_similarity") == 0), 1.0).otherwise(0.0))


def with_real_scores(df: DataFrame, scores: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Replace both proxies by scores (id, cosine, lexical share): without a cosine the proxy stays, without a share it is 0."""
    joined = df.join(scores.select(F.col("id").alias("__id"), "cosine", "share"), F.col(id_col) == F.col("__id"), "left")
    real = joined.withColumn("semantic_sim", F.coalesce(clip(F.col("cosine")), "semantic_sim")).withColumn("bm25_score", clip(or_else("share", 0.0)))
    return stuffing(real.drop("__id", "cosine", "share"))


def linear_score(df: DataFrame, weights: Mapping[str, float] = specs.POOL_WEIGHTS) -> DataFrame:
    return df.withColumn("pool_score", weighted(weights))


def model_score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series] | None) -> DataFrame:
    """Score by a model over ``MODEL_COLUMNS`` in Arrow batches; the linear score without one, and for batches that the model fails on."""
    if predict is None:
        return linear_score(df)
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(columns: pd.DataFrame) -> pd.Series:
        try:
            return pd.Series(predict(columns), dtype="float64")
        except Exception as e:  # whatever a model that was passed in may raise
            warnings.warn(f"the model failed, the linear score stands in: {e!r}", stacklevel=2)
            return pd.Series([None] * len(columns), dtype="float64")

    scored = linear_score(df).withColumn("__model", run(F.struct(*MODEL_COLUMNS)))
    return scored.withColumn("pool_score", F.coalesce(F.nanvl("__model", F.lit(None).cast("double")), "pool_score")).drop("__model")


def packed(df: DataFrame, k: int = 100, id_col: str = "candidate_id") -> DataFrame:
    """The k best with rank and a 0..100 score; all equal gives 50."""
    best = top(df, k, [("pool_score", True), (id_col, False)])
    scaled = with_min_max(best, "pool_score", "__unit", flat=0.5, few=True).withColumn("final_score", F.round(F.col("__unit") * 100, 2)).drop("__unit")
    return rank_top(scaled, [("pool_score", True), (id_col, False)])


def percent_features(columns: tuple[str, ...] = MODEL_COLUMNS) -> Column:
    share = lambda c: F.least(F.col(c) / 3.0, F.lit(1.0)) if c == "quality_score" else F.col(c)
    return F.struct(*(F.round(share(c) * 100, 1).alias(c) for c in columns))


def career_steps(n: int = 5, year: int = 2020) -> Column:
    """The first spells as role, company and starting year."""
    return F.transform(F.slice("__career", 1, n), lambda j: F.struct(
        F.coalesce(j["title"], F.lit("")).alias("role"), F.coalesce(j["company"], F.lit("")).alias("company"),
        F.coalesce(F.try_to_number(F.substring(j["start_date"], 1, 4), F.lit("9999")).cast("int"), F.lit(year)).alias("year"),
    ))


def term_histogram(df: DataFrame, matched: Column, k: int = 15) -> DataFrame:
    """The k most frequent matched terms."""
    return df.select(F.explode(matched).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(k)


def signal_statistics(ranked: DataFrame, signals: tuple[str, ...], least: float = 0.3, k: int = 6) -> DataFrame:
    """For each signal: rows above ``least``, their mean rank and mean value as percent."""
    stacked = F.inline(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals)))
    return (
        ranked.select("rank", stacked).filter(F.col("value") > least).groupBy("signal")
        .agg(F.count("*").alias("n"), F.round(F.avg("rank"), 1).alias("mean_rank"), F.round(F.avg("value") * 100, 1).alias("mean_percent"))
        .orderBy(F.col("n").desc(), "signal").limit(k)
    )


def rejection_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("keyword_stuffing_risk") > 0).alias("keyword_traps"), F.count_if(F.col("anti_skill_penalty") > 0.3).alias("foreign_skills"),
        F.count_if(F.col("skill_coverage") < 0.25).alias("few_skills"), F.count_if(F.col("seniority_alignment") < 0.5).alias("seniority_off"),
    )


def funnel(total: DataFrame, retrieved: DataFrame, ranked: DataFrame, shortlist: float = 30.0, score: str = "final_score") -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    end = ranked.agg(F.count("*").alias("ranked"), F.count_if(F.col(score) >= shortlist).alias("shortlisted"))
    return one(total, "total").crossJoin(one(retrieved, "retrieved")).crossJoin(end)
