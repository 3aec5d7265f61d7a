"""Family rankings: affinities of title, skills and career to role families."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions import text as tx
from sieveline.functions.numbers import weighted
from sieveline.schema import JobSpec


def affinity(text: Column, terms: tuple[str, ...], whole_words: bool = True) -> Column:
    """Terms found, as a number."""
    return (tx.words_hit if whole_words else tx.hits_in)(text, terms)


def best_family(text: Column, families: Mapping[str, tuple[str, ...]], whole_words: bool = True) -> Column:
    """The family with most terms in the text; the first one wins ties, none is Unknown."""
    hits = F.array(*(affinity(text, t, whole_words) for t in families.values()))
    names = F.array(*map(F.lit, families))
    most = F.array_max(hits)
    return F.when(most == 0, "Unknown").otherwise(F.element_at(names, F.array_position(hits, most).cast("int")))


def family_features(df: DataFrame, spec: JobSpec, roles=None, skills=None, whole_words: bool = True, strict: bool = True) -> DataFrame:
    """Affinities, families and consistency over the text columns of ``with_texts``.

    strict: the frozen variant. Otherwise similarity is left at 0, the career is judged by role
    families, the skill family follows the job from two hits on, and a job family that isn't
    configured switches consistency off.
    """
    roles, skills = roles or specs.ROLE_FAMILIES, skills or specs.SKILL_FAMILIES
    title, own, said = F.col("current_title"), F.col("skills_text"), F.col("description_text")
    n_skills, n_words = max(len(spec.req_skills), 1), max(len(spec.keywords), 1)
    both = F.concat_ws(" ", own, said)
    skill_family = best_family(own, skills, whole_words)
    if not strict and spec.family in skills:
        skill_family = F.when(affinity(own, skills[spec.family], whole_words) >= 2, spec.family).otherwise(skill_family)
    out = df.withColumns({
        "title_affinity": F.least(affinity(title, spec.title_terms, whole_words) / 2.0, F.lit(1.0)),
        "skill_affinity": affinity(own, spec.req_skills, whole_words) / float(n_skills),
        "career_affinity": affinity(said, spec.keywords, whole_words) / float(n_words),
        "semantic_sim": affinity(both, spec.keywords, whole_words) / float(n_words) if strict else F.lit(0.0),
        "title_family": best_family(title, roles, whole_words),
        "skill_family": skill_family,
        "career_family": best_family(said, skills if strict else roles, whole_words),
    }).withColumn("bm25_score", F.col("semantic_sim") * (0.8 if strict else 0.0))
    each = [F.col(c) for c in ("title_family", "skill_family", "career_family")]
    same = lambda c: c == spec.family
    other = lambda c: (c != spec.family) & (c != "Unknown")
    known = F.lit(strict or spec.family in roles)
    consistent = same(each[0]) & same(each[1]) & same(each[2])
    inconsistent = other(each[0]) & other(each[1]) & other(each[2])
    trap = title.rlike("engineer|developer|scientist|data") if "Sales" in spec.family else (tx.any_in(title, specs.TRAP_TITLES) & ~F.contains(title, F.lit("engineer")))
    return out.withColumns({
        "is_consistent": consistent, "is_inconsistent": inconsistent & known, "is_partial": ~consistent & ~inconsistent & known, "is_trap": trap,
    })


def frozen_score(df: DataFrame, weights: Mapping[str, float] = specs.FAMILY_WEIGHTS) -> DataFrame:
    """Weighted sum, two off unless all families agree with the job."""
    off = F.when(F.col("is_partial") | F.col("is_inconsistent"), -2.0).otherwise(0.0)
    return df.withColumn("penalties", off).withColumn("final_score", weighted(weights) + F.col("penalties"))


def scaled_score(df: DataFrame, weights: Mapping[str, float] = specs.FAMILY_WEIGHTS) -> DataFrame:
    """Weighted sum as 0..100, four fifths of it unless all families agree with the job."""
    total = weighted(weights)
    kept = F.when(F.col("is_partial") | F.col("is_inconsistent"), total * 0.8).otherwise(total)
    return df.withColumn("final_score", F.greatest(kept / sum(weights.values()) * 100, F.lit(0.0)))


def contributions(weights: Mapping[str, float] = specs.FAMILY_WEIGHTS) -> dict[str, Column]:
    return {f"{k}_contribution": F.col(k) * w for k, w in weights.items()}


def matched_and_missing(text: Column, required: tuple[str, ...]) -> tuple[Column, Column]:
    found = F.array_compact(F.array(*(F.when(tx.has_word(text, t), t.lower()) for t in required)))
    return found, F.array_except(tx.terms(required), found)


def transferable(text: Column, required: tuple[str, ...], transfers: Mapping[str, str] = specs.TRANSFERS) -> DataFrame | tuple[Column, Column, Column]:
    """Bonus, risk and evidence for needs that a neighbouring skill may meet."""
    wanted = [t.lower() for t in required]
    found = F.array_compact(F.array(*(
        F.when(F.contains(text, F.lit(have)) & ~F.contains(text, F.lit(need)), f"{have.capitalize()} may transfer to {need}")
        for have, need in transfers.items() if need in wanted
    ))) if any(n in wanted for n in transfers.values()) else F.array().cast("array<string>")
    bonus = F.size(found) * 0.5
    return bonus / float(max(len(required), 1)), F.when(bonus > 1, "low").when(bonus > 0, "medium").otherwise("high"), found


def job_family(title: str, families: Mapping[str, tuple[str, ...]] = specs.ROLE_FAMILIES, default: str = "Search Engineer") -> str:
    """The first family with a term in the job's title; decided when the plan is built."""
    return next((f for f, t in families.items() if any(x in title.lower() for x in t)), default)


def spec_of_job(job: Mapping, families: Mapping[str, tuple[str, ...]] = specs.ROLE_FAMILIES) -> JobSpec:
    """What a parsed job asks for; fields that are missing or empty come from others.

    Title terms from the title and its words, required skills from the hard ones, keywords from the
    soft and the preferred ones, the family from the title. Decided when the plan is built.
    """
    title = job.get("title") or ""
    terms = tuple(job.get("title_terms") or (([title, *title.split()]) if "title" in job else ()))
    required = tuple(job.get("req_skills") or job.get("required_hard_skills") or ())
    keywords = tuple(job.get("keywords") or (*job.get("required_soft_skills", ()), *job.get("preferred_skills", ())))
    return JobSpec(family=job.get("family") or job_family(title, families), keywords=keywords, title_terms=terms, req_skills=required)


def required_skills(job: Mapping) -> tuple[str, ...]:
    """Distinct lower-case hard and soft skills of a job, in order."""
    return tuple(dict.fromkeys(s.lower() for s in (*job.get("required_hard_skills", ()), *job.get("required_soft_skills", ()))))


def quality_shares(ranked: DataFrame) -> DataFrame:
    """One row: percent of traps, consistent, partly consistent and inconsistent rows of a ranking."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 4)
    return ranked.agg(share("is_trap").alias("trap"), share("is_consistent").alias("consistent"), share("is_partial").alias("partial"), share("is_inconsistent").alias("inconsistent"))
