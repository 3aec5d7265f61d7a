"""Comparisons: sets across records, regressions, head to head, matching and showcase scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions import text as tx


def skill_owners(df: DataFrame, id_col: str, skill: str) -> DataFrame:
    """For each record: skills that all share, that only it has, and that others have but not it.

    Counting a skill's owners replaces comparing every pair of records.
    """
    owned = df.select(F.col(id_col).alias("id"), F.lower(skill).alias("skill")).distinct()
    owners = owned.groupBy("skill").agg(F.count("*").alias("owners"))
    n, skills = owned.agg(F.countDistinct("id").alias("n")), owners.agg(F.count("*").alias("total"))
    marked = owned.join(owners, "skill").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(skills))
    return marked.groupBy("id").agg(
        F.count_if(F.col("owners") == F.col("n")).alias("shared"), F.count_if(F.col("owners") == 1).alias("unique"), (F.first("total") - F.count("*")).alias("missing")
    )


def regression(base: DataFrame, now: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Ranks whose record differs or whose score moved beyond the tolerance; ranks of one side count."""
    a = base.select("rank", F.col("id").alias("base_id"), F.col("score").alias("base_score"))
    b = now.select("rank", F.col("id").alias("now_id"), F.col("score").alias("now_score"))
    differs = ~F.col("base_id").eqNullSafe(F.col("now_id")) | (F.abs(F.col("base_score") - F.col("now_score")) > tolerance)
    return a.join(b, "rank", "full").filter(F.coalesce(differs, F.lit(True)))


def head_to_head(a: DataFrame, b: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row: totals, dimensions won and the winner; a tie goes to the first. Both sides must have one row."""
    if a.limit(2).count() != 1 or b.limit(2).count() != 1:
        raise ValueError("both sides must have one row")
    left, right = a.select(*(F.col(d).alias(f"a_{d}") for d in dimensions)), b.select(*(F.col(d).alias(f"b_{d}") for d in dimensions))
    total = lambda p: sum((F.col(f"{p}_{d}") for d in dimensions), F.lit(0.0))
    wins = lambda p, q: sum(((F.col(f"{p}_{d}") > F.col(f"{q}_{d}")).cast("int") for d in dimensions), F.lit(0))
    return left.crossJoin(right).select(total("a").alias("a_total"), total("b").alias("b_total"), wins("a", "b").alias("a_wins"), wins("b", "a").alias("b_wins")).withColumn(
        "winner", F.when(F.col("a_total") >= F.col("b_total"), "a").otherwise("b")
    )


def two_way(a: Column, terms: tuple[str, ...]) -> Column:
    """Terms that contain one of the names or lie in one."""
    return F.filter(tx.terms(terms), lambda t: F.exists(a, lambda s: F.contains(s, t) | (F.contains(t, s) & (s != ""))))


def showcase_relevance() -> Column:
    """Hits in skills, profile and career and the best assessment, over the columns of ``with_texts``."""
    names = F.transform("__skills", lambda s: tx.low(s["name"]))
    profile = F.concat_ws(" ", tx.low(F.col("profile.headline")), tx.low(F.col("profile.summary")), F.col("current_title"))
    best = F.coalesce(F.array_max(F.map_values("__signals.skill_assessment_scores")), F.lit(0.0))
    return F.size(two_way(names, specs.SHOWCASE_SKILLS)) * 3 + tx.hits_in(profile, specs.SHOWCASE_PROFILE) * 2 + tx.hits_in(F.col("career_text"), specs.SHOWCASE_CAREER) + 4 * best / 100.0


# Shares of a showcase score by feature.
SHOWCASE_SHARES = {"title": 0.22, "skill": 0.34, "career": 0.24, "semantic": 0.08, "lexical": 0.06, "quality": 0.06}


def showcase_contributions(score: Column) -> Column:
    """Struct of fixed shares of a display score."""
    return F.struct(*(F.round(score * w, 2).alias(k) for k, w in SHOWCASE_SHARES.items()))


def showcase_summary(ranked: DataFrame, score: str = "final_score") -> DataFrame:
    """One row: shortlisted (30 or more), strong (70 or more) and the shortlisted that aren't strong."""
    out = ranked.agg(F.count_if(F.col(score) >= 30).alias("shortlisted"), F.count_if(F.col(score) >= 70).alias("strong"))
    return out.withColumn("additional", F.col("shortlisted") - F.col("strong"))


# For a skill that is missing, skills that stand in for it, in order: risk and reason.
STAND_INS = {
    "react": {"vue": ("Low", "Both are component-based JS frameworks."), "angular": ("Medium", "Different architecture but similar frontend concepts."), "svelte": ("Low", "Component-based architecture.")},
    "python": {"ruby": ("Low", "Both are dynamic scripting languages."), "java": ("Medium", "Different paradigms but strong OOP foundation.")},
    "aws": {"gcp": ("Low", "Equivalent cloud infrastructure concepts."), "azure": ("Low", "Equivalent cloud concepts.")},
    "sql": {"nosql": ("Medium", "Different data models but general database familiarity."), "postgresql": ("Low", "Direct SQL dialect.")},
    "c++": {"c": ("Low", "Same family of systems languages."), "rust": ("Medium", "Memory management paradigms differ.")},
    "machine learning": {"data analysis": ("High", "Foundational statistics but lacks model building."), "deep learning": ("Low", "Advanced ML application.")},
    "kubernetes": {"docker swarm": ("Medium", "Container orchestration concepts transfer.")},
    "node.js": {"express": ("Low", "Express is a Node.js framework.")},
    "java": {"c#": ("Low", "Very similar syntax and OOP paradigms.")},
}
RISKS = ("High", "Medium", "Low")


def stand_ins(missing: Column, own: Column, known: dict[str, dict[str, tuple[str, str]]] = STAND_INS) -> Column:
    """Structs (missing, skill, risk, reason): for each missing skill the first of its stand-ins that is among the own, both in lower case."""
    rows = F.array(*(F.struct(F.lit(m).alias("missing"), F.lit(s).alias("skill"), F.lit(r).alias("risk"), F.lit(why).alias("reason")) for m, alts in known.items() for s, (r, why) in alts.items()))
    first = F.transform(missing, lambda m: F.get(F.filter(rows, lambda x: (x["missing"] == F.lower(m)) & F.array_contains(own, x["skill"])), F.lit(0)))
    return F.filter(first, lambda x: x.isNotNull())


def overall_risk(found: Column) -> Column:
    """The gravest risk among stand-ins."""
    risks = F.transform(found, lambda x: x["risk"])
    out = F.lit("None")
    for r in reversed(RISKS):
        out = F.when(F.array_contains(risks, r), r).otherwise(out)
    return out


def domain_found_in(wanted: Column, experiences: Column) -> Column:
    """Companies of the spells whose company or description names the domain."""
    low = F.lower(wanted)
    hit = F.filter(experiences, lambda e: F.contains(F.lower(F.coalesce(e["company"], F.lit(""))), low) | F.contains(F.lower(F.coalesce(e["description"], F.lit(""))), low))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(hit, lambda e: F.coalesce(e["company"], F.lit("Unknown"))))))


def match_dimensions(c: dict[str, Column]) -> dict[str, Column]:
    """Ten 0..100 dimensions of how a parsed record meets parsed needs.

    c: required, skills (arrays of lower-case names), title, wanted_title, years, wanted_years, domain,
    wanted_domain, archetype (strings or numbers), has_education, wants_education, has_certification,
    wants_certification, has_projects, is_current (booleans), transferable (number).
    """
    matched, needed = F.size(F.array_intersect(c["required"], c["skills"])), F.size(F.array_distinct(c["required"]))
    title = F.when(c["wanted_title"] == "", 100).when(c["title"] == c["wanted_title"], 100).when(F.contains(c["title"], c["wanted_title"]) | F.contains(c["wanted_title"], c["title"]), 80).otherwise(40)
    over = c["years"] - c["wanted_years"]
    years = F.when(c["wanted_years"] <= 0, 100).when(over >= 0, F.least(F.lit(100), 80 + F.floor(5 * over))).otherwise(F.greatest(F.lit(0), F.floor(100 * c["years"] / F.when(c["wanted_years"] > 0, c["wanted_years"]))))
    kinds = F.when(c["archetype"] == "fast_climber", 100).when(c["archetype"] == "stable_performer", 80).when(c["archetype"] == "chaotic_hopper", 40).otherwise(60)
    return {
        "skill_match": F.when(needed == 0, 100).otherwise(F.floor(100 * matched / F.when(needed > 0, needed))).cast("int"),
        "title_match": title,
        "experience_match": years.cast("int"),
        "domain_match": F.when((c["wanted_domain"] == "") | (c["domain"] == c["wanted_domain"]), 100).otherwise(0),
        "education_match": F.when(~c["wants_education"] | c["has_education"], 100).otherwise(60),
        "certification_match": F.when(~c["wants_certification"] | c["has_certification"], 100).otherwise(60),
        "project_match": F.when(c["has_projects"], 100).otherwise(70),
        "trajectory_match": kinds,
        "recency_match": F.when(c["is_current"], 100).otherwise(60),
        "adjacency_match": F.least(F.lit(100), 50 + 15 * c["transferable"]).cast("int"),
    }
