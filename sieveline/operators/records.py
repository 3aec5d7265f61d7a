"""Records put together from parsed parts, and rows for display."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.numbers import or_else
from sieveline.operators import extract as ex
from sieveline.operators.aliases import longest_inside
from sieveline.storage import stored

# How a range of dates is written.
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DATE = rf"(?:{_MONTH}\s+)?\d{{4}}|\d{{1,2}}[/\-]\d{{4}}"
RANGE = rf"(?i)\b({_DATE})\s*(?:–|—|-|to)\s*({_DATE}|Present|Current|Now|Till Date|Ongoing)\b"
CAREER_HEADS = ("experience", "employment", "work history", "career", "professional experience", "work experience", "positions held")
BETWEEN = r"(?i)\s+[-–—|@,]\s+|\s+at\s+"

# Certificates and how they are written.
CERTIFICATES = {
    "AWS Certified Solutions Architect": r"AWS\s+Certified\s+Solutions\s+Architect", "AWS Certified Developer": r"AWS\s+Certified\s+Developer",
    "AWS Certified SysOps Administrator": r"AWS\s+Certified\s+SysOps", "AWS Certified DevOps Engineer": r"AWS\s+Certified\s+DevOps",
    "Microsoft Certified Azure": r"Microsoft\s+Certified.*?Azure", "Azure Fundamentals": r"Azure\s+Fundamentals", "Azure Solutions Architect": r"Azure\s+Solutions\s+Architect",
    "CKA - Certified Kubernetes Administrator": r"\bCKA\b", "CKAD - Certified Kubernetes Application Developer": r"\bCKAD\b", "CISSP": r"\bCISSP\b",
    "CEH - Certified Ethical Hacker": r"\bCEH\b", "PMP - Project Management Professional": r"\bPMP\b", "Certified Scrum Master": r"Certified\s+Scrum\s+Master|CSM\b",
    "Professional Scrum Master": r"Professional\s+Scrum\s+Master|PSM\b", "CCNA": r"\bCCNA\b", "CCNP": r"\bCCNP\b", "CCIE": r"\bCCIE\b", "Databricks Certified": r"Databricks\s+Certified",
    "SnowPro": r"SnowPro\s+Core|SnowPro", "Google Cloud Certified": r"Google\s+Cloud\s+(Professional|Associate)|GCP\s+(Professional|Associate)\s+Certified",
    "AWS Cloud Practitioner": r"Certified\s+Cloud\s+Practitioner|Cloud\s+Practitioner", "HashiCorp Certified Terraform Associate": r"HashiCorp\s+Certified.*?Terraform",
    "CPA - Certified Public Accountant": r"\bCPA\b", "CFA - Chartered Financial Analyst": r"\bCFA\b", "CFE - Certified Fraud Examiner": r"\bCFE\b",
    "Certified Data Engineer": r"Certified\s+Data\s+Engineer", "Red Hat Certified Engineer": r"RHCE|Red\s+Hat\s+Certified\s+Engineer",
    "Red Hat Certified System Administrator": r"RHCSA|Red\s+Hat\s+Certified\s+System\s+Administrator", "CKS - Kubernetes Security Specialist": r"Certified\s+Kubernetes\s+Security\s+Specialist|CKS\b",
    "CompTIA Security+": r"CompTIA\s+Security\+|Security\s+\+", "CompTIA Network+": r"CompTIA\s+Network\+", "CompTIA A+": r"CompTIA\s+A\+",
    "OSCP - Offensive Security Certified Professional": r"OSCP|Offensive\s+Security\s+Certified", "ISO 27001 Lead Implementer": r"ISO\s+27001\s+Lead\s+Implementer",
    "ISO 27001 Lead Auditor": r"ISO\s+27001\s+Lead\s+Auditor", "TOGAF Certified": r"TOGAF", "Certified SAFe": r"Certified\s+SAFe", "Six Sigma Black Belt": r"Six\s+Sigma\s+Black\s+Belt",
    "Six Sigma Green Belt": r"Six\s+Sigma\s+Green\s+Belt", "TensorFlow Developer Certificate": r"TensorFlow\s+Developer\s+Certificate",
}


def certificates(text: Column) -> Column:
    """Structs (name, evidence) of the certificates that a text mentions."""
    each = F.array(*(F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(n).alias("name"), F.trim(F.replace(F.regexp_extract(text, f"(?is)(.{{0,20}}(?:{p}).{{0,80}})", 1), F.lit("\n"), F.lit(" "))).alias("evidence"))) for n, p in CERTIFICATES.items()))
    return F.array_compact(each)


def _split_role(line: Column, other: Column) -> Column:
    """Struct (title, company, inverted) of a line that holds both, or of two lines; inverted where the company stands first."""
    parts = F.split(line, BETWEEN)
    a, b = F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))
    a_role, b_role, one, two = ex.is_role_title(a), ex.is_role_title(b), ex.is_role_title(line), ex.is_role_title(other)
    of = lambda title, company, inverted=False: F.struct(title.alias("title"), company.alias("company"), F.lit(inverted).alias("inverted"))
    inline = F.when(b_role & ~a_role, of(b, a, True)).when(a_role, of(a, b)).otherwise(of(b, a))
    lines = F.when(two & ~one, of(other, line, True)).otherwise(of(line, other))
    return F.when(F.size(parts) >= 2, inline).when(other != "", lines).otherwise(of(line, F.lit("")))


def career_blocks(df: DataFrame, id_col: str, text: str | Column, now: Column, undated: Column | None = None) -> DataFrame:
    """id, pos, title, company, start_date, end_date, months, is_current, inverted, bullets, evidence, confidence for each written range of dates.

    Title and company stand in the last lines before a range: the part that names a role is the title. Without a company that of
    the range before holds on. What follows up to the next range are bullets. A text without ranges gives its lines that are role
    titles (of ``undated`` if given), without dates.
    """
    body = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), body.alias("text"), (body if undated is None else F.coalesce(undated, F.lit(""))).alias("loose"))
    rows = rows.withColumn("__blocks", F.split("text", RANGE)).withColumn("__starts", F.regexp_extract_all("text", F.lit(RANGE), F.lit(1))).withColumn("__ends", F.regexp_extract_all("text", F.lit(RANGE), F.lit(2)))
    dated = rows.select("id", "__blocks", "__ends", F.posexplode("__starts").alias("pos", "start_date"))
    dated = dated.select("id", "pos", F.get("__blocks", F.col("pos")).alias("before"), F.get("__blocks", F.col("pos") + 1).alias("after"), "start_date", F.get("__ends", F.col("pos")).alias("end_date"))
    lines = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    above = F.filter(lines("before"), lambda x: (F.length(x) > 2) & (F.length(x) < 120) & ~F.lower(x).isin(*CAREER_HEADS))
    dated = dated.withColumn("__above", above)
    dated = dated.withColumn("__one", F.coalesce(F.try_element_at("__above", F.lit(-1)), F.lit(""))).withColumn("__two", F.coalesce(F.try_element_at("__above", F.lit(-2)), F.lit("")))
    dated = dated.withColumn("__role", _split_role(F.col("__one"), F.col("__two"))).withColumn("title", F.col("__role.title"))
    said = F.nullif(F.nullif(F.col("__role.company"), F.lit("")), F.lit("Unknown Company"))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = dated.withColumn("company", F.coalesce(F.last(said, ignorenulls=True).over(so_far), F.lit("")))
    dated = dated.withColumn("__r", ex.month_range(F.col("start_date"), F.col("end_date"), now))
    bullets = F.slice(F.filter(lines("after"), lambda x: (x != "") & ~x.rlike(RANGE.replace("(?i)", "(?i)\\A", 1))), 1, 5)
    named, role, placed, valid = F.col("title") != "", ex.is_role_title(F.col("title")), F.col("company") != "", F.col("__r.first").isNotNull() & F.col("__r.last").isNotNull()
    sure = 0.5 + F.when(named & role, 0.2).when(named, 0.1).otherwise(0.0) + F.when(placed, 0.2).otherwise(0.0) + F.when(valid, 0.1).otherwise(0.0)
    evidence = F.array_compact(F.array(
        F.when(named & role, F.concat(F.lit("Title matched ontology: "), "title")).when(named, F.concat(F.lit("Title found: "), "title")), F.when(placed, F.concat(F.lit("Company found: "), "company")),
        F.when(valid, F.concat(F.lit("Valid dates: "), "start_date", F.lit(" - "), "end_date")),
    ))
    out = dated.select(
        "id", "pos", "title", "company", "start_date", "end_date", F.col("__r.months").alias("months"), F.col("__r.is_current").alias("is_current"), F.col("__role.inverted").alias("inverted"),
        bullets.alias("bullets"), evidence.alias("evidence"), F.round(F.least(sure, F.lit(1.0)), 2).alias("confidence"),
    )
    bare = rows.filter(F.size("__starts") == 0).select("id", F.posexplode(F.filter(lines("loose"), lambda x: (x != "") & ex.is_role_title(x))).alias("pos", "line"))
    parts = F.split("line", BETWEEN)
    inline, a, b = F.size(parts) >= 2, F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))
    first = ex.is_role_title(F.get(parts, F.lit(0)))
    blank = F.lit("")
    bare = bare.select(
        "id", "pos", F.when(~inline, F.col("line")).when(first, a).otherwise(b).alias("title"), F.when(~inline, blank).when(first, b).otherwise(a).alias("company"), blank.alias("start_date"), blank.alias("end_date"),
        F.lit(0).alias("months"), F.lit(False).alias("is_current"), F.lit(False).alias("inverted"), F.array().cast("array<string>").alias("bullets"),
        F.array(F.when(inline, "Role keyword inline match").otherwise("Role keyword match")).alias("evidence"), F.when(inline, 0.6).otherwise(0.5).alias("confidence"),
    )
    return out.unionByName(bare)


def normalise_titles(titles: DataFrame, column: str, fixed: DataFrame, aliases: DataFrame, least: int = 6, about: DataFrame | None = None) -> DataFrame:
    """Adds normalised and method: by a fixed map, by alias, by the longest alias inside the title, else the title itself.

    fixed, aliases: alias, canonical; equal joins and one scan of each distinct title for the aliases inside it, so neither has a largest size.
    about: canonical, family, seniority, which are then added too.
    """
    if about is not None:
        named = normalise_titles(titles, column, fixed, aliases, least)
        facts = about.select(F.col("canonical").alias("__c"), "family", "seniority")
        joined = named.join(facts, (F.col("normalised") == F.col("__c")) & (F.col("method") != "none"), "left").drop("__c")
        return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("family", "seniority")})
    key = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    distinct = titles.select(key.alias("__t")).distinct()
    hard = fixed.select(F.lower("alias").alias("__t"), F.col("canonical").alias("__hard"))
    soft = aliases.select(F.lower("alias").alias("__t"), F.col("canonical").alias("__soft"))
    named = stored(distinct.join(hard, "__t", "left").join(soft, "__t", "left"), "titles")
    long = soft.filter(F.length("__t") >= least).groupBy(F.col("__t").alias("alias")).agg(F.max("__soft").alias("__part"))
    inside = longest_inside(named.filter("__hard IS NULL AND __soft IS NULL").select(F.col("__t").alias("text")), long.select("alias"))
    part = inside.join(long, "alias").select(F.col("text").alias("__t"), "__part")
    named = named.join(part, "__t", "left")
    method = F.when(F.col("__hard").isNotNull(), "hardcoded").when(F.col("__soft").isNotNull(), "alias").when(F.col("__part").isNotNull(), "partial").otherwise("none")
    named = named.select("__t", F.coalesce("__hard", "__soft", "__part").alias("__n"), method.alias("method"))
    return titles.withColumn("__t", key).join(named, "__t", "left").withColumn("normalised", F.coalesce("__n", F.col(column))).drop("__t", "__n")


def parsed_record(source: str, signals: str = "signals") -> Column:
    """A nested profile as the struct that parsing makes."""
    skills = F.transform("skills", lambda s: F.struct(s["name"].alias("name"), F.lit("hard").alias("type")))
    return F.struct(
        F.col("profile.anonymized_name").alias("full_name"), or_else("profile.headline", "").alias("headline"), or_else("profile.summary", "").alias("summary"),
        F.col("profile.current_title").alias("current_title"), or_else("profile.years_of_experience", 0.0).alias("total_years_of_experience"), skills.alias("skills"),
        F.col("career_history"), F.col(signals).alias("signals"), F.lit(source).alias("source"), F.col("candidate_id").alias("external_id"),
    )


def keyword_signals(text: Column, groups: Mapping[str, tuple[str, ...]]) -> Column:
    """Names of the groups with a keyword in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(low, k)), n) for n, ks in groups.items())))


def encoder_text(summary: Column, title: Column, skills: Column, experiences: Column, technologies: Column) -> Column:
    """What a pair model reads: summary, title, sure skills, three roles, technologies."""
    sure = F.transform(F.filter(skills, lambda s: ~F.coalesce(s["negated"], F.lit(False)) & (F.coalesce(s["confidence"], F.lit(0.0)) >= 0.6)), lambda s: s["name"])
    roles = F.transform(F.slice(experiences, 1, 3), lambda e: F.coalesce(e["title"], F.lit("")))
    tools = F.array_sort(F.array_distinct(F.slice(technologies, 1, 10)))
    part = lambda label, a, sep: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, sep)))
    return F.concat_ws(". ", F.nullif(summary, F.lit("")), F.when(title != "", F.concat(F.lit("Current: "), title)), part("Skills: ", sure, ", "), part("Recent roles: ", roles, " → "), part("Project tech: ", tools, ", "))


def text_list(c: Column) -> Column:
    """A comma-separated text as a list, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def signal_lines(rate: Column, notice: Column) -> Column:
    """Lines of behaviour; both defaults if both are missing."""
    half_up = F.floor(rate * 100 + 0.5).cast("string")
    found = F.array_compact(F.array(F.when(rate.isNotNull(), F.concat(F.lit("Response Rate: "), half_up, F.lit("%"))), F.when(notice.isNotNull(), F.concat(F.lit("Notice Period: "), notice.cast("string"), F.lit(" days")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Response Rate: 0%"), F.lit("Notice Period: 30 days")))


def display_row(name: Column, score: Column, years: Column, matched: Column, missing: Column, shortlist: int = 30) -> Column:
    """Struct (match_score, is_low, narrative) of a ranked row."""
    whole = F.floor(F.coalesce(score, F.lit(0.0)) + 0.5).cast("int")
    low = whole < shortlist
    gaps = F.coalesce(F.nullif(F.array_join(F.slice(missing, 1, 3), ", "), F.lit("")), F.lit("role and skill fit"))
    fits = F.coalesce(F.nullif(F.array_join(F.slice(matched, 1, 4), ", "), F.lit("")), F.lit("core requirements"))
    below = F.concat(name, F.lit(" scores below the shortlist threshold ("), whole.cast("string"), F.lit("%). Primary gaps: "), gaps, F.lit("."))
    spent = F.when(F.coalesce(years, F.lit(0.0)) > 0, F.concat(F.lit(" with "), years.cast("string"), F.lit(" years of experience"))).otherwise("")
    above = F.concat(name, F.lit(" is a "), whole.cast("string"), F.lit("% match for this role"), spent, F.lit(". Strong alignment on "), fits, F.lit("."))
    return F.struct(whole.alias("match_score"), low.alias("is_low"), F.when(low, below).otherwise(above).alias("narrative"))


def score_sentence(score: Column, missing: Column) -> Column:
    return F.concat(F.format_string("Match score: %.2f. Missing skills: ", score), F.coalesce(missing, F.lit("None")))


def pool_sentences() -> Column:
    """Reasons of the pool ranking, over its feature columns."""
    years = F.col("years_of_experience")
    named = F.initcap("current_title")
    opener = F.when(years > 0, F.concat(named, F.format_string(" with %.1f years of experience.", years))).otherwise(F.concat(named, F.lit(".")))
    grade = lambda c, high, some: F.when(F.col(c) > 0.8, high).when(F.col(c) > 0.4, some)
    return F.concat_ws(
        " ", opener, grade("title_similarity", "Perfectly aligned job title and role history.", "Highly relevant professional background."),
        grade("skill_coverage", "Possesses all core required skills (Python, Elasticsearch, FAISS).", "Strong coverage of the required technical stack."),
        F.when(F.col("seniority_alignment") > 0.8, "Matches the target seniority exactly."), F.when(F.col("quality_score") > 1.0, "Exceptional profile completeness and verified signals."),
        F.when(F.col("anti_skill_penalty") > 0.5, "Note: partial domain overlap with non-target skills detected."),
    )


# Groups of keywords that a job text is scanned for.
JOB_SIGNALS = {
    "Retrieval": ("retrieval", "search", "query", "information retrieval", "ir"),
    "Ranking": ("ranking", "rank", "relevance", "ndcg", "mrr"),
    "Vector Search": ("vector", "embedding", "faiss", "ann", "similarity", "dense"),
    "Production ML": ("production", "deploy", "serving", "inference", "scale", "pipeline"),
    "Startup Experience": ("startup", "founding", "early-stage", "scrappy", "0-to-1"),
    "Evaluation Frameworks": ("evaluation", "metrics", "a/b test", "benchmark", "offline eval"),
    "LLM / RAG": ("llm", "rag", "large language model", "gpt", "transformer", "generative"),
    "NLP": ("nlp", "natural language", "tokeniz", "bert", "language model"),
    "Leadership": ("lead", "manage", "principal", "staff", "architect", "director"),
    "Infrastructure": ("infrastructure", "distributed", "microservice", "kubernetes", "cloud"),
}


def record_contains(record: Column, wanted: Column | str) -> Column:
    """Whether any value of a nested record holds the text, whatever its case; field names don't count."""
    values = F.regexp_replace(F.to_json(record), r'"(?:[^"\\]|\\.)*":', "")
    return F.contains(F.lower(values), F.lower(F.lit(wanted) if isinstance(wanted, str) else wanted))


def parse_status(parsed: Column) -> Column:
    """processing, failed or ready of a JSON record that may hold an error."""
    return F.when(parsed.isNull(), "processing").when(F.get_json_object(parsed, "$.error").isNotNull(), "failed").otherwise("ready")


def ranking_status(status: Column) -> Column:
    """What a ranking's latest job says of it."""
    return F.when(status.isNull(), "not_started").when(status.isin("pending", "processing"), "in_progress").when(status == "failed", "error").otherwise("results")


def flagged(jobs: DataFrame, owner: Column, created: str, parsed: str, tie: str, flag: str = "is_default_showcase", status: str = "status") -> DataFrame:
    """The newest active job of an owner whose JSON requirements carry the flag."""
    hit = jobs.filter(owner & (F.col(status) == "active") & (F.get_json_object(parsed, f"$.{flag}") == "true"))
    return hit.orderBy(F.col(created).desc(), tie).limit(1)


def experience_label(title: Column, company: Column) -> Column:
    """title at company, either alone, or recent role."""
    t, c = (F.trim(F.coalesce(x, F.lit(""))) for x in (title, company))
    return F.when((t != "") & (c != ""), F.concat(t, F.lit(" at "), c)).when(t != "", t).when(c != "", c).otherwise("recent role")


def display_rejections(rows: DataFrame, domain: str, depth: str, final: str) -> DataFrame:
    """Counts of shown rows below the limits; a missing dimension doesn't count, a missing score counts as 0."""
    return rows.agg(
        F.count_if(F.col(domain) < 50).alias("lacks_domain"), F.count_if(F.col(depth) < 30).alias("lacks_skills"), F.count_if(F.coalesce(F.col(final), F.lit(0.0)) < 40).alias("trajectory_mismatch"),
    )


def domain_authenticity(penalty: Column) -> Column:
    """1 without a penalty, 0 from a hundred on."""
    return F.greatest(F.lit(0.0), 1 - penalty / 100.0)


def shown(name: Column, title: Column, score: Column, years: Column, domain: Column, availability: Column, search: str = "", least_score: float = 0, least_years: float = 0, least_domain: float = 0, available: bool = False) -> Column:
    """Whether a row passes the filters of a list: text in name or title, and lower bounds."""
    low = search.lower()
    named = F.lit(True) if not low else F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(low))
    bounds = (F.coalesce(score, F.lit(0.0)) >= least_score) & (F.coalesce(years, F.lit(0.0)) >= least_years) & (F.coalesce(domain, F.lit(0.0)) >= least_domain)
    return named & bounds & ((F.coalesce(availability, F.lit(0.0)) >= 1) if available else F.lit(True))
