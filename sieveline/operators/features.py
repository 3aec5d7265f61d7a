"""Features of a profile relative to a job specification: columns over the nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions.dates import day, whole_months
from sieveline.functions.numbers import clip, or_else, sigmoid
from sieveline.schema import JobSpec


def with_texts(df: DataFrame, signals: str = "signals") -> DataFrame:
    """Flat text columns that the features share: computed once a record, not once a feature."""
    career = F.coalesce("career_history", F.array().cast(df.schema["career_history"].dataType))
    skills = F.coalesce("skills", F.array().cast(df.schema["skills"].dataType))
    own = tx.low(F.col("profile.current_title"))
    out = df.withColumn("__career", career).withColumn("__skills", skills).withColumn("__signals", F.col(signals))
    out = out.withColumn("current_title", F.when(own != "", own).otherwise(tx.low(F.get("__career", F.lit(0))["title"])))
    out = out.withColumn("skills_text", F.array_join(F.transform("__skills", lambda s: tx.low(s["name"])), " "))
    out = out.withColumn("career_text", F.array_join(F.transform("__career", lambda j: F.concat_ws(" ", tx.low(j["title"]), tx.low(j["description"]))), " "))
    out = out.withColumn("description_text", F.array_join(F.transform("__career", lambda j: tx.low(j["description"])), " "))
    out = out.withColumn("trajectory_text", F.concat_ws(" ", tx.low(F.col("profile.headline")), tx.low(F.col("profile.summary")), F.col("career_text")))
    return out.withColumn("full_text", F.concat_ws(" ", "skills_text", "trajectory_text"))


def lexical_document() -> Column:
    """The text that retrieval by words sees; case kept."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    skills = F.array_join(F.transform("__skills", lambda s: F.coalesce(s["name"], F.lit(""))), " ")
    career = F.array_join(F.transform("__career", lambda j: F.concat_ws(" ", F.coalesce(j["title"], F.lit("")), F.coalesce(j["description"], F.lit("")))), " ")
    return F.concat_ws(" ", part("profile.headline"), part("profile.summary"), part("profile.current_title"), skills, career)


def embedding_document() -> Column:
    """The text that an encoder sees."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.format_string("%s | %s | %s %s %s", part("profile.headline"), part("profile.current_title"), part("profile.summary"), F.col("skills_text"), F.col("career_text"))


def skill_trust(skill: Column) -> Column:
    """Grows with months of use and endorsements."""
    months, endorsed = or_else(skill["duration_months"], 0) / 24.0, or_else(skill["endorsements"], 0) / 12.0
    return clip(0.25 + 0.45 * F.least(months, F.lit(1.0)) + 0.30 * F.least(endorsed, F.lit(1.0)))


def skill_coverage(required: tuple[str, ...]) -> Column:
    """Mean trust of the first skill whose name contains each required term.

    Skills of equal names count as one: at the place of the first, with the values of the last.
    """

    def trust(term: str) -> Column:
        first = F.get(F.filter("__skills", lambda s: F.contains(tx.low(s["name"]), F.lit(term.lower()))), F.lit(0))
        last = F.try_element_at(F.filter("__skills", lambda s: tx.low(s["name"]) == tx.low(first["name"])), F.lit(-1))
        return F.when(first.isNotNull(), skill_trust(last)).otherwise(0.0)

    covered = sum(map(trust, required), F.lit(0.0))
    return F.least(covered / max(len(required), 1), F.lit(1.0))


def specialist_bonus(specialist: tuple[str, ...], full: int = 3) -> Column:
    present = F.size(F.filter(tx.terms(specialist), lambda t: F.exists("__skills", lambda s: F.contains(tx.low(s["name"]), t))))
    return F.least(present / float(full), F.lit(1.0))


def months_worked() -> Column:
    return F.aggregate("__career", F.lit(0), lambda s, j: s + or_else(j["duration_months"], 0))


def years_of_experience() -> Column:
    own = or_else("profile.years_of_experience", 0.0)
    return F.when(own > 0, own).otherwise(months_worked() / 12.0)


def seniority_alignment(years: Column, low: float, high: float) -> Column:
    below, above = F.greatest(F.lit(0.0), 1 - (low - years) / 5.0), F.greatest(F.lit(0.0), 1 - (years - high) / 12.0)
    return F.when(years < low, below).when(years > high, above).otherwise(1.0)


def quality_score() -> Column:
    """An absent code score (-1) takes a hundredth off: only the upper side is bounded."""
    s = lambda c, d: or_else(f"__signals.{c}", d)
    flags = F.when(s("verified_email", False), 0.5).otherwise(0.0) + F.when(s("linkedin_connected", False), 0.5).otherwise(0.0)
    return s("profile_completeness_score", 50.0) / 100.0 + F.least(s("github_activity_score", 0.0) / 100.0, F.lit(1.0)) + flags


def activity_recency(reference: str) -> Column:
    days = F.datediff(F.lit(reference).cast("date"), day(F.col("__signals.last_active_date")))
    return F.coalesce(clip(1 - F.greatest(F.lit(0), days - 30) / 150.0), F.lit(0.5))


def hireability(reference: str) -> Column:
    s = lambda c, d: or_else(f"__signals.{c}", d)
    friction = sigmoid(s("notice_period_days", 90), 0.05, 45)
    saved = F.least(s("saved_by_recruiters_30d", 0) / 10.0, F.lit(1.0))
    open_flag = F.when(s("open_to_work_flag", False), 1.0).otherwise(0.0)
    return 0.30 * s("recruiter_response_rate", 0.0) + 0.20 * activity_recency(reference) + 0.15 * open_flag + 0.15 * (1 - friction) + 0.10 * s("interview_completion_rate", 0.0) + 0.10 * saved


def startup_readiness(firms: tuple[str, ...]) -> Column:
    """0 if every employer is one of the service firms, else 1."""
    service = F.size(F.filter("__career", lambda j: tx.any_in(tx.low(j["company"]), firms)))
    return F.when((service >= 1) & (service == F.size("__career")), 0.0).otherwise(1.0)


def reliability() -> Column:
    mean = months_worked() / 12.0 / F.size("__career")
    return F.when(F.size("__career") == 0, 0.5).when(mean < 1.5, 0.0).otherwise(F.least(mean / 3.0, F.lit(1.0)))


def location_fit(spec: JobSpec) -> Column:
    place, country = tx.low(F.col("profile.location")), tx.low(F.col("profile.country"))
    home = tx.any_in(place, spec.home_places) | (F.contains(country, F.lit(spec.home_places[-1])) if spec.home_places else F.lit(False))
    return F.when(tx.any_in(place, spec.preferred_cities), 1.0).when(home, 0.85).when(or_else("__signals.willing_to_relocate", False), 0.6).otherwise(0.25)


def relative_features(df: DataFrame, spec: JobSpec, signals: str = "signals") -> DataFrame:
    """All features of the relative ranking; proxies stand in for similarity until real scores are joined."""
    out = with_texts(df, signals) if "__skills" not in df.columns else df
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    title = F.col("current_title")
    out = out.withColumns({
        "semantic_proxy": tx.hits_in(F.col("full_text"), spec.keywords) / float(max(len(spec.keywords), 1)),
        "title_similarity": F.least(tx.words_hit(title, spec.title_terms) / 2.0, F.lit(1.0)),
        "skill_coverage": skill_coverage(spec.req_skills),
        "specialist_skill_bonus": specialist_bonus(spec.specialist),
        "years_of_experience": years_of_experience(),
        "quality_score": quality_score(),
        "hireability_score": hireability(spec.reference_date),
        "startup_readiness": startup_readiness(spec.consulting),
        "behavioral_reliability": reliability(),
        "location_fit": location_fit(spec),
        "__off": tx.any_in(title, spec.offdomain_titles) & ~(tx.any_in(title, spec.relevant_titles) | tx.any_word(title, spec.relevant_titles)),
        "research_only_penalty": flag(tx.any_in(F.col("trajectory_text"), spec.research_markers) & ~tx.any_in(F.col("trajectory_text"), spec.production_markers)),
        "narrow_domain_penalty": flag((tx.any_word(title, spec.narrow_domain) | tx.any_word(F.col("full_text"), spec.narrow_domain)) & ~tx.any_word(F.col("full_text"), spec.counter_domain)),
    })
    return out.withColumns({
        "semantic_sim": F.col("semantic_proxy"),
        "bm25_score": F.col("semantic_proxy") * 0.8,
        "seniority_alignment": seniority_alignment(F.col("years_of_experience"), spec.seniority_min, spec.seniority_max),
        "offdomain_title_penalty": flag(F.col("__off")),
        "keyword_trap_penalty": flag((F.col("semantic_proxy") > 0.25) & ((F.col("title_similarity") == 0.0) | F.col("__off"))),
    }).drop("__off")


def integrity(df: DataFrame, reference: str, signals: str = "signals") -> DataFrame:
    """Adds honeypot (0 or 1) and honeypot_reasons: records that contradict themselves."""
    out = with_texts(df, signals) if "__skills" not in df.columns else df
    years, today = or_else("profile.years_of_experience", 0.0), F.lit(reference).cast("date")
    start = lambda j: day(j["start_date"])
    span = lambda j: whole_months(start(j), F.when(j["end_date"].isNull(), today).otherwise(day(j["end_date"])))
    months = lambda j: or_else(j["duration_months"], 0)
    over = lambda test: F.coalesce(F.exists("__career", lambda j: F.coalesce(test(j), F.lit(False))), F.lit(False))
    unused = F.size(F.filter("__skills", lambda s: tx.low(s["proficiency"]).isin("advanced", "expert") & (or_else(s["duration_months"], 0) == 0)))
    rules = {
        "current_with_end": over(lambda j: or_else(j["is_current"], False) & j["end_date"].isNotNull()),
        "end_before_start": over(lambda j: span(j) < 0),
        "expert_without_use": unused >= 3,
        "months_beyond_career": over(lambda j: (years > 0) & (months(j) > years * 12 + 18)),
        "months_unlike_dates": over(lambda j: F.abs(months(j) - span(j)) > 9),
    }
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items())))), ",")
    return out.withColumn("honeypot_reasons", reasons).withColumn("honeypot", F.when(F.col("honeypot_reasons") != "", 1.0).otherwise(0.0))
