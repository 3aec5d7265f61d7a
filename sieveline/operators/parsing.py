"""Skills, jobs, education, careers and whole records read out of free text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numbers import or_else
from sieveline.operators import extract as ex
from sieveline.operators import intervals, records
from sieveline.operators.aliases import AT_ONCE, CASED, STRICT, first_aliases
from sieveline.storage import stored

EDGE = r"[\s,/()|;:.]"
LEADER = r"(?i)lead|manager|director|vp|chief|head"
JOB_ROLE = r"(?i)(Engineer|Developer|Manager|Analyst|Scientist|Architect|Associate|Director|VP|Lead)"
YEARS_BY_LEVEL = {"senior": "5 years", "lead": "8 years", "junior": "1 year", "mid": "3 years"}
NO_SCHOOL = ("computer", "science", "technology", "engineering", "business", "arts", "mathematics", "statistics")

def alias_pattern(alias: Column) -> Column:
    """The regular expression that finds an alias as a word of its own; dots in it may be missing, hyphens may be blanks."""
    low = F.lower(F.trim(alias))
    marks = F.regexp_replace(low, r"([^\p{L}\p{N}\s_])", r"\\$1")
    loose = F.replace(F.replace(marks, F.lit(r"\."), F.lit(r"\.?")), F.lit(r"\-"), F.lit(r"[\-\s]?"))
    between = F.concat(F.lit(f"(?:(?<={EDGE})|^)"), loose, F.lit(f"(?={EDGE}|$)"))
    found = F.when((F.length(low) <= 3) | low.isin(*STRICT), between).otherwise(F.concat(F.lit(r"\b"), loose, F.lit(r"\b")))
    return F.concat(F.when((F.length(alias) <= 3) & low.isin(*CASED), "(?mU)").otherwise("(?miU)"), found)


def snippet(text: Column, start: Column, length: Column) -> Column:
    """From 40 characters before a place (counted from 1) to 100 after it, on one line."""
    first = F.greatest(F.lit(1), start - 40)
    return F.trim(F.replace(F.substring(text, first, start + length + 100 - first), F.lit("\n"), F.lit(" ")))


def alias_skills(df: DataFrame, id_col: str, text: str, aliases: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """id, skill, category, alias, evidence, confidence: the first alias of each canonical name that a text holds as a word.

    aliases: canonical, aliases (array, tried in order), category, pos (order of the names). Texts are scanned once for
    every ``at_once`` aliases.
    """
    spread = aliases.select("canonical", "category", "pos", F.posexplode("aliases").alias("n", "alias")).filter("alias IS NOT NULL")
    spread = spread.groupBy(F.col("canonical").alias("name"), "n").agg(F.min(F.struct("pos", "category", "alias")).alias("a")).select("name", "n", "a.*")
    spread = stored(spread, "aliases")
    # Category and place travel with the aliases, so that what is found meets no table.
    hits = first_aliases(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), spread, at_once, ("category", "pos"))
    return hits.select("id", F.col("name").alias("skill"), "category", "alias", "pos", "evidence", F.lit(0.90).alias("confidence"))


def skills_with_evidence(df: DataFrame, id_col: str, text: str, aliases: DataFrame, compounds: Iterable[str] = ex.COMPOUNDS) -> DataFrame:
    """id, skill, category, evidence, method, confidence: compounds by containment, then aliases of names that no compound gave."""
    compounds = tuple(compounds)
    titled = F.create_map(*(F.lit(x) for c in compounds for x in (c, c.title())))
    a = ex.compound_skills(df, id_col, text, compounds).select("id", titled[F.col("skill")].alias("skill"), F.lit(None).cast("string").alias("category"), "evidence", F.lit("n-gram").alias("method"), "confidence")
    b = alias_skills(df, id_col, text, aliases).join(a.select("id", "skill"), ["id", "skill"], "left_anti")
    return a.unionByName(b.select("id", "skill", "category", "evidence", F.lit("alias").alias("method"), "confidence"))


def mode_with_share(df: DataFrame, key: list[str], value: str, order: str, total: Column) -> DataFrame:
    """key, value, n, share: the most common value (ties: the least ``order``, then the greatest value), its count, and that as percent of ``total``, whole, 100 at most."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = counts.groupBy(*key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("__first"), value)).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n")).withColumn("share", F.least(F.lit(100), F.floor(F.col("n") * 100 / F.greatest(F.lit(1), total))).cast("int"))


def job_title(text: Column) -> Column:
    """The first role word with up to twenty letters and blanks before it; empty without one."""
    role = F.regexp_extract(text, JOB_ROLE, 1)
    return F.when(role == "", "").otherwise(F.trim(F.call_function("regexp_extract", text, F.concat(F.lit(r"(?i)([a-zA-Z\s]{0,20}"), role, F.lit(")")), F.lit(1))))


def wanted_experience(text: Column) -> Column:
    """As the job says it, or by its seniority."""
    said, level = F.regexp_extract(text, ex.YEARS, 1), ex.seniority(text)
    by_level = F.create_map(*(F.lit(x) for kv in YEARS_BY_LEVEL.items() for x in kv))
    return F.when(said != "", F.concat(said, F.lit(" years"))).otherwise(by_level[level])


def parse_jobs(
    df: DataFrame, id_col: str, text: str, aliases: DataFrame, titles: DataFrame | None = None, fixed: DataFrame | None = None, compounds: Iterable[str] = ex.COMPOUNDS
) -> DataFrame:
    """id, title, seniority, skills, experience, certifications, domain, domain_confidence, supporting, missing for each job text.

    titles, fixed: alias, canonical as for ``records.normalise_titles``; without them the title is found by role words alone.
    """
    jobs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = skills_with_evidence(df, id_col, text, aliases, compounds)
    by_name = aliases.select(F.col("canonical").alias("skill"), "pos")
    ordered = found.join(F.broadcast(by_name), "skill", "left").withColumn("place", F.coalesce("pos", F.lit(-1)))
    named = ordered.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "skill", "category"))).alias("s"))
    named = named.select("id", "s", F.transform("s", lambda x: x["skill"]).alias("skills"))
    total = named.select("id", F.size("skills").alias("total"))
    modes = mode_with_share(ordered.join(total, "id"), ["id", "total"], "category", "place", F.col("total")).select("id", "category", "share")
    out = jobs.join(named, "id", "left").join(modes, "id", "left")
    if titles is None:
        title = job_title(F.col("text"))
    else:
        empty = titles.filter("1 = 0")
        out = records.normalise_titles(out, "text", empty if fixed is None else fixed, titles)
        title = F.when(F.col("method") != "none", F.col("normalised")).otherwise(job_title(F.col("text")))
    skills = F.coalesce("skills", F.array().cast("array<string>"))
    domain = F.coalesce("category", F.lit(""))
    supporting = F.slice(F.transform(F.filter("s", lambda x: x["category"] == F.col("category")), lambda x: x["skill"]), 1, 5)
    out = out.withColumns({"title": title, "skills": skills, "domain": domain})
    certs = F.filter("skills", lambda s: F.endswith(s, F.lit("Certified")) | F.contains(s, F.lit("Certification")))
    gaps = F.array_compact(F.array(F.when(F.col("title") == "", "title"), F.when(F.size("skills") == 0, "skills"), F.when(F.col("domain") == "", "domain")))
    return out.select(
        "id", "title", ex.seniority(F.col("text")).alias("seniority"), "skills", wanted_experience(F.col("text")).alias("experience"), certs.alias("certifications"), "domain",
        F.coalesce("share", F.lit(0)).alias("domain_confidence"), F.coalesce(supporting, F.array().cast("array<string>")).alias("supporting"), gaps.alias("missing"),
    )


def education(text: Column) -> Column:
    """Structs (degree, institution, field, evidence) of the degrees that a text names."""
    start = F.replace(F.substring(text, 1, 150), F.lit("\n"), F.lit(" "))
    field = F.trim(F.regexp_extract(F.substring(text, 1, 150), r"(?i)(?:in|of)\s+([A-Za-z][^\n,\.]{2,40})", 1))

    def one(name: str, pattern: str) -> Column:
        school = F.trim(F.regexp_extract(text, rf"(?i)(?:{pattern})[,\s]+([A-Z][^\n,]{{3,50}})", 1))
        school = F.when((school == "") | F.lower(school).isin(*NO_SCHOOL), "University").otherwise(school)
        return F.when(text.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("degree"), school.alias("institution"), field.alias("field"), start.alias("evidence")))

    return F.array_compact(F.array(*(one(n, p) for n, p in ex.DEGREES.items())))


def leadership_years(experiences: Column, pattern: str = LEADER) -> Column:
    """Whole years, one at least, of each spell whose title leads."""
    led = F.filter(experiences, lambda e: F.coalesce(e["title"], F.lit("")).rlike(pattern))
    return F.aggregate(led, F.lit(0).cast("long"), lambda s, e: s + F.greatest(F.lit(1), F.floor(F.coalesce(e["months"], F.lit(12)) / 12)))


def career_graph(blocks: DataFrame, now: Column) -> DataFrame:
    """id, total_years, relevant_years, leadership_years, promotion_count, company_count, career_velocity, inversion_count.

    blocks: id, pos (newest first), title, company, start_date, end_date, months, inverted as ``records.career_blocks`` gives them.
    Overlapping spells count once; relevant are those whose title names a role; an inversion is a company that stands before its title.
    """
    span = ex.month_range(F.col("start_date"), F.col("end_date"), now)
    spells = blocks.withColumn("__r", span).select("id", "pos", "title", "company", "months", "inverted", F.col("__r.first").alias("a"), F.col("__r.last").alias("b"), ex.is_role_title(F.col("title")).alias("role"))

    def years(rows: DataFrame, name: str) -> DataFrame:
        whole = intervals.merged(rows.filter("a IS NOT NULL AND b IS NOT NULL"), ["id"], "a", "b")
        return whole.groupBy("id").agg((F.sum(F.col("b") - F.col("a")) / 12).alias(name))

    led = spells.groupBy("id").agg(
        F.sum(F.when(F.col("title").rlike(LEADER), F.greatest(F.lit(1), F.floor(F.col("months") / 12))).otherwise(0)).cast("long").alias("leadership_years"),
        F.count_if("inverted").alias("inversion_count"),
    )
    # Oldest first: a change of title since the company was last seen is a promotion.
    ups = intervals.promotions(spells.withColumn("__age", -F.col("pos")), ["id"], "company", "title", "__age", "title")
    ids = blocks.select("id").distinct()
    out = ids.join(years(spells, "total_years"), "id", "left").join(years(spells.filter("role"), "relevant_years"), "id", "left").join(led, "id", "left").join(ups, "id", "left")
    out = out.na.fill(0.0, ["total_years", "relevant_years"])
    # A hair is added lest a quotient that is half a tenth, such as 9 promotions in 160 months, come out below it.
    velocity = F.round(F.col("promotions") / F.greatest(F.lit(1.0), F.col("total_years")) * 10 + 1e-9, 1)
    return out.select(
        "id", "total_years", "relevant_years", "leadership_years", F.col("promotions").alias("promotion_count"), F.col("companies").alias("company_count"), velocity.alias("career_velocity"), "inversion_count"
    )


def assembled_records(df: DataFrame, id_col: str, text: str, aliases: DataFrame, titles: DataFrame, fixed: DataFrame, now: Column) -> DataFrame:
    """One nested record for each text: contacts, name, title, career and its graph, education, skills, certificates and confidences."""
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ex.name_candidates(texts, "id", "text").select("id", "name", ex.name_confidence(F.col("score")).alias("name_confidence"))
    told = ex.sections(texts, "id", F.col("text")).filter("section = 'Experience'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    told = texts.join(told, "id", "left").withColumn("lines", F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")))
    told = told.withColumn("lines_text", F.array_join("lines", "\n"))
    blocks = records.career_blocks(told, "id", F.when(F.size("lines") > 2, F.col("lines_text")).otherwise(F.col("text")), now, F.col("lines_text"))
    graph = career_graph(blocks, now).withColumn("career_graph", F.struct("total_years", "relevant_years", "leadership_years", "promotion_count", "company_count", "career_velocity", "inversion_count")).select("id", "career_graph")
    spell = F.struct("pos", "title", "company", "start_date", "end_date", "months", "is_current", "bullets", "evidence", "confidence")
    career = blocks.groupBy("id").agg(F.array_sort(F.collect_list(spell)).alias("career_history"))
    skills = skills_with_evidence(texts, "id", "text", aliases)
    skills = skills.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("skill", "confidence", "method", "evidence"))).alias("skills"))
    out = texts.join(names, "id", "left").join(career, "id", "left").join(graph, "id", "left").join(skills, "id", "left")
    out = out.withColumn("raw_title", F.coalesce(F.get("career_history", F.lit(0))["title"], F.lit("")))
    out = records.normalise_titles(out, "raw_title", fixed, titles)
    sure = F.when(F.col("raw_title") == "", 0.0).when(F.col("method").isin("hardcoded", "alias"), 0.95).when(F.col("method") == "partial", 0.75).otherwise(0.5)
    skill_sure = F.least(F.lit(1.0), F.coalesce(F.size("skills"), F.lit(0)) / 20.0)
    out = out.withColumns({"title_confidence": sure, "skill_confidence": F.greatest(skill_sure, F.lit(0.0)), "name_confidence": or_else("name_confidence", 0.0)})
    overall = F.round((F.col("name_confidence") + F.col("title_confidence") + F.col("skill_confidence")) / 3.0, 2)
    summary = ex.sections(texts, "id", F.col("text")).filter("section = 'Summary'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    summary = summary.select("id", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), " "), 1, 500).alias("summary"))
    out = out.join(summary, "id", "left")
    return out.select(
        "id", F.col("name").alias("full_name"), F.when(F.col("method") != "none", F.col("normalised")).otherwise(F.col("raw_title")).alias("current_title"), "raw_title",
        F.coalesce("summary", F.lit("Deterministically extracted resume profile.")).alias("summary"), F.struct(ex.email(F.col("text")).alias("email"), ex.phone(F.col("text")).alias("phone")).alias("contact"),
        F.when(F.get("career_history", F.lit(0))["is_current"], "Employed").otherwise("Unknown").alias("current_employment_status"), "career_history", "career_graph",
        education(F.col("text")).alias("education"), "skills", records.certificates(F.col("text")).alias("certifications"), "name_confidence", "title_confidence", "skill_confidence", overall.alias("overall_confidence"),
    )
