"""Reasons in words for a place in a ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions.numbers import or_else
from sieveline.schema import JobSpec


def concern(spec: JobSpec) -> Column:
    """The first of seven doubts that applies, else empty."""
    s = lambda c, d: or_else(f"__signals.{c}", d)
    rate, notice = s("recruiter_response_rate", 1.0), s("notice_period_days", 0)
    return (
        F.when(F.col("narrow_domain_penalty") > 0, "Concern: background looks primarily computer-vision/speech with limited NLP/IR.")
        .when(F.col("offdomain_title_penalty") > 0, "Concern: current title is off-domain; included on adjacent signals only.")
        .when(F.col("research_only_penalty") > 0, "Concern: research-heavy profile with little production/product signal.")
        .when(rate < 0.2, F.concat(F.lit("Concern: low recruiter response rate ("), tx.percent(rate), F.lit(") — availability risk.")))
        .when((F.col("location_fit") <= 0.6) & ~s("willing_to_relocate", False), F.concat(F.lit("Concern: based in "), F.coalesce("profile.location", F.lit("abroad")), F.lit(", outside India and not marked willing to relocate.")))
        .when(notice >= 90, F.concat(F.lit("Concern: long notice period ("), notice.cast("string"), F.lit(" days).")))
        .when(F.col("years_of_experience") < spec.seniority_min, F.concat(F.format_string("Concern: %.1f", "years_of_experience"), F.lit(" yrs is below the 5-9 year target band.")))
        .otherwise("")
    )


def relevant_skills(spec: JobSpec, k: int = 4) -> Column:
    names = F.array_distinct(F.filter(F.transform("__skills", lambda s: F.trim(F.coalesce(s["name"], F.lit("")))), lambda n: (n != "") & tx.any_in(F.lower(n), spec.specialist + spec.req_skills)))
    return F.slice(names, 1, k)


def reasoning(spec: JobSpec) -> Column:
    """Opener by rank, fit, skills, signals, concern."""
    title = F.coalesce(F.nullif(F.trim(F.coalesce("profile.current_title", F.lit(""))), F.lit("")), F.lit("professional"))
    years = F.format_string("%.1f", "years_of_experience")
    opener = F.element_at(F.array(
        F.concat(title, F.lit(" with "), years, F.lit(" yrs' experience")), F.concat(years, F.lit("-year "), title),
        F.concat(title, F.lit(" ("), years, F.lit(" yrs)")), F.concat(F.lit("Experienced "), title, F.lit(", "), years, F.lit(" yrs")),
    ), F.pmod(F.col("rank") - 1, F.lit(4)).cast("int") + 1)
    special, fits = F.col("specialist_skill_bonus") >= 0.66, F.col("title_similarity") >= 0.5
    fit = (
        F.when(special & fits, "Strong retrieval/ranking profile matching the AI-engineer JD.").when(fits, "Role and title align with the JD.")
        .when(special, "Carries the specialist retrieval/ML skills the JD asks for despite an adjacent title.").otherwise("")
    )
    named = relevant_skills(spec)
    skills = F.when(F.size(named) > 0, F.concat(F.lit("Relevant skills: "), F.array_join(named, ", "), F.lit("."))).otherwise("")
    rate, notice = F.col("__signals.recruiter_response_rate"), F.col("__signals.notice_period_days")
    facts = F.array_compact(F.array(
        F.when(rate.isNotNull(), F.concat(tx.percent(rate), F.lit(" recruiter response"))), F.when(or_else("__signals.open_to_work_flag", False), "open to work"),
        F.when(notice.isNotNull(), F.concat(notice.cast("string"), F.lit("d notice"))),
    ))
    said = F.when(F.size(facts) > 0, F.concat(F.lit("Signals: "), F.array_join(facts, ", "), F.lit("."))).otherwise("")
    return F.array_join(F.filter(F.array(F.concat(opener, F.lit(".")), fit, skills, said, concern(spec)), lambda p: p != ""), " ")


def match_explanation(matched: Column, missing: Column, k: int = 3) -> Column:
    """Strengths and gaps of a match."""
    part = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(F.slice(a, 1, k), ", ")))
    return F.coalesce(F.nullif(F.concat_ws("; ", part("Strengths: ", matched), part("Gaps: ", missing)), F.lit("")), F.lit("No required skills"))


def match_report(matched: Column, missing: Column, years: Column, wanted_years: Column, domain: Column, domain_score: Column, trajectory_score: Column, adjacent: Column) -> Column:
    """Struct of strengths, gaps, adjacent skills, risks, assessment and evidence for one match."""
    shown = years.cast("string")
    listed = lambda a, k: F.array_join(F.slice(a, 1, k), ", ")
    or_none = lambda a: F.when(F.size(a) > 0, listed(a, 5)).otherwise("None")
    # These sentences.
    strengths = F.array_compact(F.array(F.when(F.size(matched) > 0, F.concat(F.lit("Strong match for core skills: "), listed(matched, 3))), F.concat(shown, F.lit(" years of professional experience."))))
    risks = F.array_compact(F.array(F.when(trajectory_score < 50, "Career trajectory needs manual review.")))
    overall = F.concat(F.lit("Matched: "), or_none(matched), F.lit(" | Missing: "), or_none(missing), F.lit(" | YOE: "), shown, F.lit(" vs required "), wanted_years.cast("string"), F.lit(" | Domain: "), domain)
    claim = lambda c, e: F.struct(F.lit(c).alias("claim"), e.alias("evidence"))
    evidence = F.array_compact(F.array(
        F.when(F.size(matched) > 0, claim("Skill Match", F.concat(F.lit("Found skills: "), F.array_join(matched, ", ")))),
        claim("Experience", F.concat(shown, F.lit(" years vs required "), wanted_years.cast("string"), F.lit(" years."))),
        claim("Domain", F.when(domain_score > 0, F.concat(F.lit("Matched in domain: "), domain)).otherwise("No domain match found.")),
    ))
    return F.struct(strengths.alias("strengths"), missing.alias("missing"), adjacent.alias("adjacent"), risks.alias("risks"), overall.alias("assessment"), evidence.alias("evidence"))
