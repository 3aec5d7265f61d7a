"""Registered queries of parsing, matching and display, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import compare, explain, families, features, parsing, pool, records
from sieveline.operators import extract as ex
from sieveline.operators.titles import TITLES
from sieveline.plans.candidates import ROLES, SKILLS, SPEC, SQL, candidates, hits
from sieveline.plans.registry import query, r, t

#: Names, how they are written, their category.
ONTOLOGY = (
    ("The Word", ("the",), "english", 0), ("Que", ("que", "des"), "romance", 1), ("Licence", ("licence", "license", "licensed under"), "legal", 2),
    ("Rights Certified", ("rights-reserved", "all rights reserved"), "legal", 3), ("Of", ("of",), "english", 4), ("Mail", ("e-mail", "mail"), "contact", 5), ("Der", ("der", "und"), "german", 6),
    ("Kubernetes", ("k8s", "kubernetes"), "infrastructure", 7),
)
COMPOUNDS = ("the que", "licensed under", "creative commons", "rights reserved")


def ontology(spark):
    return spark.createDataFrame([(c, list(a), k, p) for c, a, k, p in ONTOLOGY], "canonical string, aliases array<string>, category string, pos int")


def _sql_pattern(alias: str) -> tuple[str, str, str]:
    """Flags, what stands before an alias, what after, for an engine without look-around."""
    low = alias.lower()
    flags = "ms" if len(alias) <= 3 and low in parsing.CASED else "msi"
    if len(low) <= 3 or low in parsing.STRICT:
        return flags, r"(?:^|[\s,/()|;:.])", r"(?:[\s,/()|;:.]|$)"
    return flags, r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def _alias_rows() -> str:
    import re

    rows = []
    for c, names, k, p in ONTOLOGY:
        for n, a in enumerate(names):
            flags, before, after = _sql_pattern(a)
            word = re.escape(a.lower()).replace(r"\.", r"\.?").replace(r"\-", r"[\-\s]?")
            rows.append(f"('{c}', '{k}', {p}, {n}, '{a}', '(?{flags})\\A(.*?{before}){word}{after}', '(?{flags}){before}({word}){after}')")
    return ", ".join(rows)


_SNIPPET = "trim(replace(substring(text, greatest(1, spot - 40), spot + n + 100 - greatest(1, spot - 40)), chr(10), ' '))"
_SKILLS = rf"""
WITH al(canonical, category, pos, k, alias, head, hit) AS (VALUES {_alias_rows()}),
d AS (SELECT doc_id AS id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
m AS (SELECT id, text, canonical, category, pos, alias, k, length(regexp_extract(text, head, 1)) + 1 AS spot, length(regexp_extract(text, hit, 1)) AS n FROM d, al WHERE contains(low, lower(alias)) AND regexp_matches(text, hit)),
a AS (SELECT id, canonical AS skill, category, pos, alias, {_SNIPPET} AS evidence FROM m QUALIFY row_number() OVER (PARTITION BY id, canonical ORDER BY k) = 1),
c AS (SELECT id, skill, {_SNIPPET} AS evidence FROM (SELECT id, text, s[2] AS skill, instr(low, s[1]) AS spot, length(s[1]) AS n FROM d, (VALUES {", ".join(f"(['{c}', '{c.title()}'])" for c in COMPOUNDS)}) v(s) WHERE contains(low, s[1])) x),
sk AS (SELECT id, skill, NULL AS category, evidence, 'n-gram' AS method, 0.95::DOUBLE AS confidence, -1 AS place FROM c
       UNION ALL SELECT id, skill, category, evidence, 'alias', 0.90, pos FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = a.id AND c.skill = a.skill))
"""


@query(_SKILLS + "SELECT id, skill, category, evidence, method, confidence FROM sk")
def res5_all_skills(spark, sf_dir):
    return parsing.skills_with_evidence(t(spark, sf_dir, "documents"), "doc_id", "text", ontology(spark), COMPOUNDS)


_LEVEL = "CASE WHEN contains(low, 'senior') THEN 'senior' WHEN contains(low, 'junior') THEN 'junior' WHEN contains(low, 'lead') OR contains(low, 'manager') THEN 'lead' ELSE 'mid' END"


@query(_SKILLS + rf""",
tot AS (SELECT id, count(*) AS total FROM sk GROUP BY 1),
cat AS (SELECT id, category, count(*) AS n, min(place) AS first FROM sk WHERE category IS NOT NULL GROUP BY 1, 2),
mode AS (SELECT id, category, n FROM cat QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1),
agg AS (SELECT id, string_agg(skill, ',' ORDER BY place, skill) AS skills, coalesce(string_agg(skill, ',' ORDER BY place, skill) FILTER (ends_with(skill, 'Certified') OR contains(skill, 'Certification')), '') AS certs FROM sk GROUP BY 1),
role AS (SELECT id, text, low, regexp_extract(text, '(?i)(Engineer|Developer|Manager|Analyst|Scientist|Architect|Associate|Director|VP|Lead)', 1) AS word, regexp_extract(text, '(?i)([0-9]+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?experience', 1) AS said FROM d)
SELECT role.id, CASE WHEN word = '' THEN '' ELSE trim(regexp_extract(text, '(?i)([a-zA-Z\s]{{0,20}}' || word || ')', 1)) END AS title, {_LEVEL} AS seniority, coalesce(skills, '') AS skills,
 CASE WHEN said <> '' THEN said || ' years' ELSE CASE {_LEVEL} WHEN 'senior' THEN '5 years' WHEN 'lead' THEN '8 years' WHEN 'junior' THEN '1 year' ELSE '3 years' END END AS experience, coalesce(certs, '') AS certifications,
 coalesce(category, '') AS domain, CASE WHEN n IS NULL THEN 0 ELSE least(100, n * 100 // total) END::INT AS domain_confidence,
 concat_ws(',', CASE WHEN word = '' THEN 'title' END, CASE WHEN skills IS NULL THEN 'skills' END, CASE WHEN category IS NULL THEN 'domain' END) AS missing
FROM role LEFT JOIN agg USING (id) LEFT JOIN mode USING (id) LEFT JOIN tot USING (id)""")
def res16_job_requirements(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    out = parsing.parse_jobs(docs, "doc_id", "text", ontology(spark), compounds=COMPOUNDS)
    flat = lambda c: F.array_join(c, ",").alias(c)
    return out.select("id", "title", "seniority", flat("skills"), "experience", flat("certifications"), "domain", "domain_confidence", flat("missing"))


@query("""WITH c AS (SELECT l_orderkey, l_shipmode AS kind, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, count(*) AS total FROM lineitem GROUP BY 1)
 SELECT l_orderkey, kind, n, least(100, n * 100 // total)::INT AS share FROM c JOIN s USING (l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, kind DESC) = 1""".replace("l_shipmode", "l_returnflag || l_linestatus"))
def agg16_mode_with_share(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    total = lines.groupBy("l_orderkey").agg(F.count("*").alias("total"))
    return parsing.mode_with_share(lines.join(total, "l_orderkey"), ["l_orderkey", "total"], "kind", "l_linenumber", F.col("total")).drop("total")


_BLOCKS = """WITH b AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos, o_orderdate AS od, o_orderkey AS ok,
 CASE o_orderkey % 3 WHEN 0 THEN 'Lead Engineer' WHEN 1 THEN 'Analyst' ELSE 'Clerk ' || o_orderstatus END AS title, o_orderpriority AS company FROM orders),
m AS (SELECT *, year(od) * 12 + month(od) AS a, year(od) * 12 + month(od) + (ok % 30 - 4)::INT AS b0 FROM b),
e AS (SELECT *, (b0 - 1) // 12 AS ey, (b0 - 1) % 12 + 1 AS em FROM m),
x AS (SELECT id, pos, title, company, od, ok, a, CASE WHEN ey < year(od) THEN year(od) ELSE ey END * 12 + em AS z, ey < year(od) AS inverted, greatest(1, CASE WHEN ey < year(od) THEN year(od) ELSE ey END * 12 + em - a) AS months FROM e),
"""


def _merged(name: str, condition: str) -> str:
    return f"""{name}0 AS (SELECT *, max(z) OVER (PARTITION BY id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM x WHERE {condition}),
{name}1 AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS isle FROM {name}0),
{name} AS (SELECT id, sum(w) / 12.0::DOUBLE AS years FROM (SELECT id, isle, max(z) - min(a) AS w FROM {name}1 GROUP BY 1, 2) GROUP BY 1),
"""


@query(_BLOCKS + _merged("tot", "TRUE") + _merged("rel", "regexp_matches(title, '(Engineer|Analyst)')") + """
p AS (SELECT id, count(*) FILTER (prev IS NOT NULL AND prev <> title) AS ups, count(DISTINCT company) AS n FROM (SELECT *, lag(title) OVER (PARTITION BY id, company ORDER BY pos DESC, title) AS prev FROM x) GROUP BY 1),
l AS (SELECT id, sum(CASE WHEN contains(title, 'Lead') THEN greatest(1, months // 12) ELSE 0 END)::BIGINT AS led, count(*) FILTER (inverted) AS inverted FROM x GROUP BY 1)
SELECT l.id, round(tot.years, 4) AS total_years, round(coalesce(rel.years, 0), 4) AS relevant_years, led AS leadership_years, ups AS promotion_count, n AS company_count,
 round(ups / greatest(1, tot.years) * 10 + 1e-9, 1) AS career_velocity, inverted AS inversion_count FROM l JOIN p USING (id) JOIN tot USING (id) LEFT JOIN rel USING (id)""")
def res10_career_graph(spark, sf_dir):
    """Total, relevant and leadership years, promotions, companies, velocity and inversions of written spells."""
    from pyspark.sql import Window

    o = t(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")) - 1
    day = F.to_date("o_orderdate")
    title = F.when(F.col("o_orderkey") % 3 == 0, "Lead Engineer").when(F.col("o_orderkey") % 3 == 1, "Analyst").otherwise(F.concat(F.lit("Clerk "), "o_orderstatus"))
    end = F.add_months(F.trunc(day, "month"), (F.col("o_orderkey") % 30 - 4).cast("int"))
    blocks = o.select(F.col("o_custkey").alias("id"), pos.alias("pos"), title.alias("title"), F.col("o_orderpriority").alias("company"), F.date_format(day, "MM/yyyy").alias("start_date"), F.date_format(end, "MM/yyyy").alias("end_date"))
    now = F.lit(SPEC.reference_date).cast("date")
    blocks = blocks.withColumn("inverted", F.substring("end_date", 4, 4) < F.substring("start_date", 4, 4))
    blocks = blocks.withColumn("months", ex.month_range(F.col("start_date"), F.col("end_date"), now)["months"])
    out = parsing.career_graph(blocks, now)
    return out.withColumns({"total_years": r("total_years", 4), "relevant_years": r("relevant_years", 4)})


@query(SQL + "SELECT candidate_id, coalesce((SELECT sum(greatest(1, months // 12)) FROM car WHERE car.id = prof.id AND regexp_matches(lower(title || ' ' || company), '1-urgent|lead')), 0)::BIGINT AS leadership_years FROM prof")
def agg19_leadership_years(spark, sf_dir):
    spells = F.transform(F.coalesce("career_history", F.array().cast(candidates(spark, sf_dir).schema["career_history"].dataType)), lambda j: F.struct(F.concat_ws(" ", j["title"], j["company"]).alias("title"), j["duration_months"].alias("months")))
    return candidates(spark, sf_dir).select("candidate_id", parsing.leadership_years(spells, "(?i)1-urgent|lead").alias("leadership_years"))


_DEG = {"MBA": ex.DEGREES["MBA"], "PhD": ex.DEGREES["PhD"], "Diploma": ex.DEGREES["Diploma"]}


@query(r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'PhD in Physics, ' || o_orderpriority WHEN 1 THEN 'Diploma, Nation School' || chr(10) || 'M.B.A. Trade Academy of Sea' WHEN 2 THEN 'diploma Science' ELSE 'no degree' END AS text FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'PhD' WHEN 1 THEN 'MBA,Diploma' WHEN 2 THEN 'Diploma' ELSE '' END AS degrees,
 CASE o_orderkey % 5 WHEN 0 THEN 'in Physics' WHEN 1 THEN 'Trade Academy of Sea,Nation School' WHEN 2 THEN 'University' ELSE '' END AS institutions, CASE o_orderkey % 5 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Sea,Sea' ELSE '' END AS fields FROM x""")
def res13_education(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("PhD in Physics, "), "o_orderpriority")).when(kind == 1, "Diploma, Nation School\nM.B.A. Trade Academy of Sea").when(kind == 2, "diploma Science").otherwise("no degree")
    got = t(spark, sf_dir, "orders").select("o_orderkey", parsing.education(text).alias("e"))
    got = got.withColumn("e", F.filter("e", lambda e: e["degree"].isin(*_DEG)))
    join = lambda f: F.array_join(F.transform("e", lambda e: e[f]), ",")
    return got.select("o_orderkey", join("degree").alias("degrees"), join("institution").alias("institutions"), join("field").alias("fields"))


@query("""WITH k AS (SELECT o_orderkey, [CASE WHEN o_orderkey % 2 = 0 THEN 'Java' ELSE 'machine learning' END, 'sql'] AS missing, CASE o_orderkey % 4 WHEN 0 THEN ['c#', 'nosql'] WHEN 1 THEN ['deep learning', 'data analysis', 'postgresql'] WHEN 2 THEN ['ruby'] ELSE ['deep learning', 'nosql', 'postgresql'] END AS own FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'c#,nosql' WHEN 1 THEN 'data analysis,postgresql' WHEN 2 THEN '' ELSE 'deep learning,nosql' END AS found,
 CASE o_orderkey % 4 WHEN 0 THEN 'Medium' WHEN 1 THEN 'High' WHEN 2 THEN 'None' ELSE 'Medium' END AS risk, CASE o_orderkey % 4 WHEN 2 THEN 50 ELSE 80 END AS adjacency_match FROM k""")
def jn13_stand_ins(spark, sf_dir):
    k = F.col("o_orderkey")
    missing = F.array(F.when(k % 2 == 0, "Java").otherwise("machine learning"), F.lit("sql"))
    lists = [F.array(*map(F.lit, x)) for x in (("c#", "nosql"), ("deep learning", "data analysis", "postgresql"), ("ruby",), ("deep learning", "nosql", "postgresql"))]
    own = F.when(k % 4 == 0, lists[0]).when(k % 4 == 1, lists[1]).when(k % 4 == 2, lists[2]).otherwise(lists[3])
    got = t(spark, sf_dir, "orders").select("o_orderkey", compare.stand_ins(missing, own).alias("f"))
    return got.select("o_orderkey", F.array_join(F.transform("f", lambda x: x["skill"]), ",").alias("found"), compare.overall_risk(F.col("f")).alias("risk"), F.least(F.lit(100), 50 + 15 * F.size("f")).alias("adjacency_match"))


@query("""SELECT l_orderkey, 'Matched: ' || l_returnflag || ' | Missing: None | YOE: ' || l_linenumber || ' vs required 5 | Domain: x' AS assessment, l_linenumber || ' years of professional experience.' AS last_strength,
 CASE WHEN l_linestatus = 'O' THEN 'Career trajectory needs manual review.' ELSE '' END AS risks, 3 AS claims FROM lineitem""")
def mat2_match_report(spark, sf_dir):
    got = explain.match_report(F.array("l_returnflag"), F.array().cast("array<string>"), F.col("l_linenumber"), F.lit(5), F.lit("x"), F.lit(0), F.when(F.col("l_linestatus") == "O", 40).otherwise(60), F.array().cast("array<string>"))
    out = t(spark, sf_dir, "lineitem").select("l_orderkey", got.alias("m"))
    return out.select("l_orderkey", "m.assessment", F.element_at("m.strengths", -1).alias("last_strength"), F.array_join("m.risks", ",").alias("risks"), F.size("m.evidence").alias("claims"))


@query("SELECT count(*) FILTER (v < 50) AS lacks_domain, count(*) FILTER (u < 30) AS lacks_skills, count(*) FILTER (coalesce(w, 0) < 40) AS trajectory_mismatch FROM (SELECT CASE WHEN event_id % 3 > 0 THEN value END AS v, user_id AS u, CASE WHEN event_type <> 'error' THEN value END AS w FROM events)")
def agg10_display_rejections(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"), F.col("user_id").alias("u"), F.when(F.col("event_type") != "error", F.col("value")).alias("w"))
    return records.display_rejections(rows, "v", "u", "w")


@query("SELECT count(*) FILTER (value >= 30) AS shortlisted, count(*) FILTER (value >= 70) AS strong, count(*) FILTER (value >= 30) - count(*) FILTER (value >= 70) AS additional FROM events")
def agg27_showcase_summary(spark, sf_dir):
    return compare.showcase_summary(t(spark, sf_dir, "events"), "value")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg') OR contains(o_custkey::VARCHAR, 'urg')")
def flt8_record_search(spark, sf_dir):
    record = F.struct(F.col("o_orderpriority").alias("urgency"), F.struct("o_orderstatus", F.col("o_custkey").cast("string").alias("customer")).alias("more"))
    return t(spark, sf_dir, "orders").filter(records.record_contains(record, "URG")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id % 7 = 3 AND event_type = 'click' AND json_extract(props, '$.k')::INT = 42 ORDER BY ts DESC, event_id LIMIT 1")
def flt20_flagged(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("event_type") == "click", "active").otherwise("closed").alias("status"), F.to_json(F.struct((F.get_json_object("props", "$.k") == "42").alias("is_default_showcase"))).alias("parsed"))
    return records.flagged(e, F.col("user_id") % 7 == 3, "ts", "parsed", "event_id").select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'processing' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'ready' END AS parse_status,
 CASE WHEN event_type = 'view' THEN 'not_started' WHEN event_type = 'click' THEN 'in_progress' WHEN event_type = 'error' THEN 'error' ELSE 'results' END AS ranking_status FROM events WHERE event_id % 4 <> 1""")
def flt21_status_machine(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id") % 4
    parsed = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, '{"error":"x"}').otherwise('{"name":"y"}')
    job = F.when(kind == "view", F.lit(None).cast("string")).when(kind == "click", "pending").when(kind == "error", "failed").otherwise("completed")
    out = t(spark, sf_dir, "events").select("event_id", records.parse_status(parsed).alias("parse_status"), records.ranking_status(job).alias("ranking_status"))
    return out.filter("parse_status <> 'failed'")


@query("SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) AND c_acctbal >= 100 AND c_nationkey >= 3 AND c_custkey % 5 >= 1")
def flt9_shown_rows(spark, sf_dir):
    keep = records.shown(F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey"), F.lit(0.0), F.col("c_custkey") % 5, search="7", least_score=100, least_years=3, available=True)
    return t(spark, sf_dir, "customer").filter(keep).select("c_custkey")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN trim(c_mktsegment) || ' at ' || c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN c_name ELSE 'recent role' END AS label FROM customer""")
def scl6_experience_label(spark, sf_dir):
    n = F.col("c_custkey") % 4
    label = records.experience_label(F.when(n.isin(0, 1), F.concat(F.lit(" "), "c_mktsegment")), F.when(n.isin(0, 2), F.col("c_name")).otherwise(" "))
    return t(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))


@query("SELECT event_id, round(0.22 * floor(value), 2)::DOUBLE AS title, round(0.34 * floor(value), 2)::DOUBLE AS skill, round(0.06 * floor(value), 2)::DOUBLE AS quality FROM events")
def sh3_showcase_contributions(spark, sf_dir):
    c = compare.showcase_contributions(F.floor("value"))
    return t(spark, sf_dir, "events").select("event_id", c["title"].alias("title"), c["skill"].alias("skill"), c["quality"].alias("quality"))


@query("""WITH k AS (SELECT o_orderkey, o_orderpriority AS firm, o_orderkey % 3 AS kind, 2010 + (o_orderkey % 9)::INT AS y FROM orders)
 SELECT o_orderkey AS id, 0 AS pos, CASE kind WHEN 0 THEN 'Lead Engineer' WHEN 1 THEN 'Data Analyst' ELSE 'Architect' END AS title, CASE kind WHEN 2 THEN 'Beta Ltd' ELSE firm END AS company, CASE kind WHEN 2 THEN 0 ELSE 26 END AS months,
 kind = 1 AS inverted, CASE kind WHEN 0 THEN 'did this,Support Manager' ELSE '' END AS bullets, CASE kind WHEN 2 THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence FROM k
 UNION ALL SELECT o_orderkey, 1, 'Support Manager', 'did this', 1, FALSE, '', 1.0 FROM k WHERE kind = 0""")
def res8_career_blocks(spark, sf_dir):
    kind, firm, year = F.col("o_orderkey") % 3, F.col("o_orderpriority"), 2010 + F.col("o_orderkey") % 9
    span = F.concat(F.lit("Jan "), year.cast("string"), F.lit(" - 03/"), (year + 2).cast("string"))
    first = F.concat(F.lit("Experience\nLead Engineer at "), firm, F.lit("\n"), span, F.lit("\ndid this\nSupport Manager\n05/2020 to 04/2019"))
    second = F.concat(firm, F.lit(" | Data Analyst\n"), span)
    text = F.when(kind == 0, first).when(kind == 1, second).otherwise("Architect at Beta Ltd\nno dates")
    got = records.career_blocks(t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", F.lit(SPEC.reference_date).cast("date"))
    return got.select("id", "pos", "title", "company", "months", "inverted", F.array_join("bullets", ",").alias("bullets"), "confidence")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'JANE DOE' WHEN 1 THEN 'Mary Ann Smith' ELSE 'Soup' END AS name, CASE c_custkey % 3 WHEN 0 THEN 155 WHEN 1 THEN 145 ELSE 120 END AS score FROM customer""")
def res3_names(spark, sf_dir):
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, "Curriculum Vitae\nJANE DOE | Engineer\nDallas, TX\njane@x.org").when(kind == 1, "Data Scientist\nMary Ann Smith - PhD\ngithub.com/mary").otherwise("Soup\nSoup\nMain Street 5")
    return ex.name_candidates(t(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


_TRANSFERS = {"ring": "gizmo", "small": "hot", "blue": "gizmo"}


@query(SQL + """, x AS (SELECT candidate_id, (contains(skills_text, 'ring') AND NOT contains(skills_text, 'gizmo'))::INT AS a, (contains(skills_text, 'small') AND NOT contains(skills_text, 'hot'))::INT AS b, (contains(skills_text, 'blue') AND NOT contains(skills_text, 'gizmo'))::INT AS c FROM txt)
 SELECT candidate_id, 0.5 * (a + b + c) / 4 AS bonus, CASE WHEN 0.5 * (a + b + c) > 1 THEN 'low' WHEN a + b + c > 0 THEN 'medium' ELSE 'high' END AS risk,
 concat_ws(',', CASE WHEN a = 1 THEN 'Ring may transfer to gizmo' END, CASE WHEN b = 1 THEN 'Small may transfer to hot' END, CASE WHEN c = 1 THEN 'Blue may transfer to gizmo' END) AS evidence FROM x""")
def fam9_transferable(spark, sf_dir):
    bonus, risk, evidence = families.transferable(F.col("skills_text"), SPEC.req_skills, _TRANSFERS)
    return features.with_texts(candidates(spark, sf_dir)).select("candidate_id", bonus.alias("bonus"), risk.alias("risk"), F.array_join(evidence, ",").alias("evidence"))


@query(SQL + """SELECT candidate_id, md5(concat_ws(' ', headline, summary, own_title, skills_text, career_text)) AS lexical, md5(headline || ' | ' || own_title || ' | ' || summary || ' ' || skills_text || ' ' || career_text) AS embedded FROM txt""")
def prj6_documents(spark, sf_dir):
    """The texts that retrieval by words and an encoder see, lower-cased."""
    c = features.with_texts(candidates(spark, sf_dir)).withColumn("current_title", F.lower("profile.current_title"))
    return c.select("candidate_id", F.md5(F.lower(features.lexical_document())).alias("lexical"), F.md5(F.lower(features.embedding_document())).alias("embedded"))


@query(SQL + """SELECT candidate_id, coalesce(string_agg(title || '|' || company || '|' || year(a), ',' ORDER BY pos) FILTER (pos <= 5), '') AS steps FROM prof LEFT JOIN car ON car.id = prof.id GROUP BY 1""")
def prj9_career_steps(spark, sf_dir):
    c = features.with_texts(candidates(spark, sf_dir))
    steps = F.transform(pool.career_steps(), lambda s: F.concat_ws("|", s["role"], s["company"], s["year"].cast("string")))
    return c.select("candidate_id", F.array_join(steps, ",").alias("steps"))


@query("""SELECT event_id, round(least(user_id / 50.0::DOUBLE / 3, 1) * 100, 1) AS quality_score, round((event_id % 7) / 8.0::DOUBLE * 100, 1) AS skill_coverage FROM events""")
def prj10_percent_features(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") / 50.0).alias("quality_score"), ((F.col("event_id") % 7) / 8.0).alias("skill_coverage"))
    return e.select("event_id", pool.percent_features(("quality_score", "skill_coverage")).alias("p")).select("event_id", "p.quality_score", "p.skill_coverage")


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, concat_ws(',', """
       + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(low, '{k}')''' for k in ks)} THEN '{n}' END" for n, ks in records.JOB_SIGNALS.items()) + ") AS signals FROM d")
def res20_job_signals(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(records.keyword_signals(F.col("text"), records.JOB_SIGNALS), ",").alias("signals"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'AWS Certified Developer,CISSP' WHEN 1 THEN 'Certified Scrum Master' WHEN 2 THEN 'Six Sigma Green Belt' ELSE '' END AS names,
 CASE o_orderkey % 4 WHEN 0 THEN 'holder of the aws certified developer badge, CISSP' WHEN 1 THEN 'CSM at ' || o_orderpriority WHEN 2 THEN 'six  sigma green belt' ELSE '' END AS first_evidence FROM orders""")
def res14_certificates(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    text = F.when(n == 0, "holder of the aws certified developer badge, CISSP").when(n == 1, F.concat(F.lit("CSM at\n"), "o_orderpriority")).when(n == 2, "six  sigma green belt").otherwise("none")
    got = t(spark, sf_dir, "orders").select("o_orderkey", records.certificates(text).alias("c"))
    return got.select("o_orderkey", F.array_join(F.transform("c", lambda c: c["name"]), ",").alias("names"), F.coalesce(F.get("c", F.lit(0))["evidence"], F.lit("")).alias("first_evidence"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Backend Engineer' WHEN 2 THEN 'Backend Engineer' WHEN 3 THEN p_name ELSE 'Cloud Architect' END AS normalised,
 CASE p_partkey % 5 WHEN 0 THEN 'hardcoded' WHEN 1 THEN 'alias' WHEN 2 THEN 'partial' WHEN 3 THEN 'none' ELSE 'hardcoded' END AS method, CASE p_partkey % 5 WHEN 1 THEN 'engineering' WHEN 2 THEN 'engineering' ELSE '' END AS family FROM part""")
def res6_titles(spark, sf_dir):
    n = F.col("p_partkey") % 5
    title = F.when(n == 0, " Growth Hacker ").when(n == 1, "BACKEND dev").when(n == 2, F.concat(F.lit("senior backend dev of "), "p_name")).when(n == 3, F.col("p_name")).otherwise("solutions architect")
    fixed = spark.createDataFrame(list(TITLES.items()), "alias string, canonical string")
    aliases = spark.createDataFrame([("backend dev", "Backend Engineer"), ("dev", "Developer")], "alias string, canonical string")
    about = spark.createDataFrame([("Backend Engineer", "engineering", "mid")], "canonical string, family string, seniority string")
    named = records.normalise_titles(t(spark, sf_dir, "part").select("p_partkey", title.alias("title")), "title", fixed, aliases, about=about)
    return named.select("p_partkey", "normalised", "method", "family")


@query("""SELECT c_custkey, floor(c_acctbal / 100.0 + 0.5)::INT AS match_score, floor(c_acctbal / 100.0 + 0.5) < 30 AS is_low,
 CASE WHEN floor(c_acctbal / 100.0 + 0.5) < 30 THEN c_name || ' scores below the shortlist threshold (' || floor(c_acctbal / 100.0 + 0.5)::INT || '%). Primary gaps: x, y.'
 ELSE c_name || ' is a ' || floor(c_acctbal / 100.0 + 0.5)::INT || '% match for this role' || CASE WHEN c_nationkey > 0 THEN ' with ' || c_nationkey || ' years of experience' ELSE '' END || '. Strong alignment on core requirements.' END AS narrative,
 'Match score: ' || printf('%.2f', c_nationkey / 4.0::DOUBLE) || '. Missing skills: None' AS explanation FROM customer WHERE c_acctbal >= 0""")
def txt5_display_rows(spark, sf_dir):
    c = t(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    none = F.array().cast("array<string>")
    row = records.display_row(F.col("c_name"), F.col("c_acctbal") / 100.0, F.col("c_nationkey"), none, F.array(F.lit("x"), F.lit("y")))
    return c.select("c_custkey", row.alias("d"), records.score_sentence(F.col("c_nationkey") / 4.0, F.lit(None).cast("string")).alias("explanation")).select("c_custkey", "d.match_score", "d.is_low", "d.narrative", "explanation")


@query("""SELECT o_orderkey, concat_ws('. ', CASE WHEN o_orderkey % 2 = 0 THEN 'S' END, 'Current: ' || o_orderstatus, 'Skills: a', 'Recent roles: x → y → z', 'Project tech: p, q') AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'Response Rate: 0%,Notice Period: 30 days' ELSE 'Notice Period: ' || o_orderkey % 3 || ' days' END AS lines FROM orders""")
def prj14_encoder_text(spark, sf_dir):
    skill = lambda n, c, neg: F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence"), F.lit(neg).alias("negated"))
    jobs = F.array(*(F.struct(F.lit(x).alias("title")) for x in ("x", "y", "z", "w")))
    n = F.col("o_orderkey") % 3
    text = records.encoder_text(F.when(F.col("o_orderkey") % 2 == 0, "S").otherwise(""), F.col("o_orderstatus"), F.array(skill("a", 0.9, False), skill("b", 0.5, False), skill("c", 0.9, True)), jobs, F.array(F.lit("q"), F.lit("p"), F.lit("q")))
    lines = records.signal_lines(F.lit(None).cast("double"), F.when(n > 0, n))
    return t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), F.array_join(lines, ",").alias("lines"))


@query(SQL + f"""SELECT candidate_id, least({hits("current_title", SPEC.title_terms)} / 2.0::DOUBLE, 1) AS title_affinity, {hits("skills_text", SPEC.req_skills)} / {len(SPEC.req_skills)}.0::DOUBLE AS skill_affinity, round({hits("description_text", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE, 9) AS career_affinity FROM txt""")
def fam12_substring_affinities(spark, sf_dir):
    fam = families.family_features(features.with_texts(candidates(spark, sf_dir)), SPEC, ROLES, SKILLS, whole_words=False)
    return fam.select("candidate_id", "title_affinity", "skill_affinity", r("career_affinity", 9).alias("career_affinity"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 100 WHEN o_orderkey % 3 = 1 THEN 50 ELSE 0 END AS skill_match, CASE WHEN o_orderkey % 4 = 0 THEN 100 WHEN o_orderkey % 4 = 1 THEN 100 ELSE 0 END AS domain_match,
 CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 60 END AS education_match, CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 100 END AS certification_match, CASE WHEN o_orderkey % 7 = 0 THEN 70 ELSE 100 END AS project_match, CASE WHEN o_orderstatus = 'O' THEN 100 ELSE 60 END AS recency_match FROM orders""")
def mat1_other_dimensions(spark, sf_dir):
    k = F.col("o_orderkey")
    lists = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    c = {
        "required": lists("a", "b"), "skills": F.when(k % 3 == 0, lists("b", "a", "c")).when(k % 3 == 1, lists("a", "x")).otherwise(lists()), "title": F.lit("x"), "wanted_title": F.lit(""), "years": F.lit(1.0), "wanted_years": F.lit(0.0),
        "domain": F.when(k % 4 == 0, "retail").otherwise("other"), "wanted_domain": F.when(k % 4 == 1, "").otherwise("retail"), "archetype": F.lit("mixed"), "has_education": k % 2 == 0, "wants_education": F.lit(True),
        "has_certification": k % 5 != 0, "wants_certification": F.lit(True), "has_projects": k % 7 != 0, "is_current": F.col("o_orderstatus") == "O", "transferable": F.lit(0),
    }
    got = compare.match_dimensions(c)
    return t(spark, sf_dir, "orders").select("o_orderkey", *(got[n].cast("int").alias(n) for n in ("skill_match", "domain_match", "education_match", "certification_match", "project_match", "recency_match")))
