"""Nested profiles derived from the star-schema tables, and the same as flat SQL for the oracle.

No profiles ship with the tables, so customers stand in for people, their orders for spells of work,
order lines for skills and events for behaviour. The rules make every default and every integrity
rule occur, and rarely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.schema import JobSpec, profile_ddl

REFERENCE = "2024-03-15"
SPEC = JobSpec(
    family="Building",
    keywords=("thatin", "orantion", "rewh", "blue ring", "urgent", "nation_1", "small", "que", "the"),
    title_terms=("engineer", "furniture", "build", "building"),
    req_skills=("ring", "small rod", "gizmo", "hot"),
    seniority_years=5,
    specialist=("gear", "anvil", "old plate", "red", "cold r"),
    offdomain_titles=("machinery", "household"),
    relevant_titles=("machinery lead", "household engineer"),
    narrow_domain=("anvil", "plate"),
    counter_domain=("gizmo", "new"),
    consulting=("1-urgent", "2-high"),
    research_markers=("f 3-medium", "o 5-low"),
    production_markers=("p 4-not", "der"),
    preferred_cities=("nation_1", "nation_7"),
    home_places=("nation_20", "nation_8", "europe"),
    reference_date=REFERENCE,
)
ROLES = {"Building": ("building", "engineer", "furniture"), "Machinery": ("machinery", "lead", "auto"), "Home": ("household", "analyst")}
SKILLS = {"Building": ("ring", "rod", "small"), "Machinery": ("gear", "bolt", "hot"), "Home": ("plate", "gizmo", "blue", "1-urgent")}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("int").alias("qty"))
    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    orders = t("orders").withColumn("pos", F.row_number().over(newest)).join(lines, "o_orderkey", "left")
    key, qty = F.col("o_orderkey"), F.coalesce("qty", F.lit(0))
    day = F.to_date("o_orderdate")
    end = F.when(key % 29 == 0, F.date_add(day, 30)).when(F.col("o_orderstatus") == "O", None).when(key % 17 == 0, F.date_add(day, -40)).otherwise(F.date_add(day, qty * 10))
    months = F.floor(qty / 3).cast("int") + F.when(key % 23 == 0, 20).otherwise(0)
    open_months = (F.lit(2024) - F.year(day)) * 12 + 3 - F.month(day)
    spell = F.struct(
        "pos", F.col("o_orderpriority").alias("company"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("title"), F.date_format(day, "yyyy-MM-dd").alias("start_date"),
        F.date_format(end, "yyyy-MM-dd").alias("end_date"), F.when(end.isNull(), open_months).otherwise(months).cast("int").alias("duration_months"), (F.col("o_orderstatus") == "O").alias("is_current"),
        F.col("o_orderstatus").alias("industry"), F.lit(None).cast("string").alias("company_size"), F.concat_ws(" ", "o_orderpriority", F.lit("order"), key.cast("string")).alias("description"),
    )
    career = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(spell)).alias("c"))
    first = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    bought = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("pos", F.row_number().over(first))
    bought = bought.join(t("part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    skill = F.struct(
        "pos", F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, ("beginner", "intermediate", "advanced", "expert"))), F.col("l_linenumber") % 4 + 1).alias("proficiency"),
        (F.col("l_quantity").cast("int") % 20).alias("endorsements"), F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("p_size")).cast("int").alias("duration_months"),
    )
    skills = bought.groupBy("o_custkey").agg(F.array_sort(F.collect_list(skill)).alias("s"))
    n, kind = F.count("*"), lambda k: F.count_if(F.col("event_type") == k)
    signals = t("events").groupBy("user_id").agg(
        F.least(F.lit(100.0), n.cast("double")).alias("complete"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_active"), (n % 2 == 1).alias("open"),
        F.round(kind("click") / n, 3).alias("response"), (F.max("event_id") % 120).cast("int").alias("notice"), (n % 3 == 0).alias("willing"),
        F.when(kind("purchase") < 10, -1.0).otherwise(kind("purchase") * 6.0).alias("code"), kind("view").cast("int").alias("saved"), F.round(kind("view") / n, 3).alias("interview"),
        (kind("signup") % 2 == 0).alias("email"), (kind("error") % 2 == 0).alias("linked"), kind("error").cast("double").alias("best"),
    )
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = people.join(t("documents").select(F.col("doc_id"), F.col("text").alias("summary")), F.col("doc_id") == F.col("c_custkey"), "left")
    people = people.join(career, F.col("c_custkey") == career.o_custkey, "left").drop("o_custkey").join(skills, F.col("c_custkey") == skills.o_custkey, "left").join(signals, F.col("user_id") == F.col("c_custkey"), "left")
    c = F.col("c_custkey")
    title = F.when(c % 4 == 0, F.lit("")).when(c % 4 == 1, F.col("c_mktsegment")).when(c % 4 == 2, F.concat_ws(" ", "c_mktsegment", F.lit("engineer"))).otherwise(F.concat_ws(" ", "c_mktsegment", F.lit("lead")))
    s = lambda x, name, kind="string": F.col(x).cast(kind).alias(name) if x else F.lit(None).cast(kind).alias(name)
    profile = F.struct(
        F.col("c_name").alias("anonymized_name"), F.concat_ws(" ", F.lower("c_mktsegment"), "n_name").alias("headline"), "summary", F.col("n_name").alias("location"), F.col("r_name").alias("country"),
        F.when(c % 11 == 0, 0.0).otherwise((c * 7 % 310) / 10.0).alias("years_of_experience"), title.alias("current_title"),
    )
    behaviour = F.when(F.col("user_id").isNotNull(), F.struct(
        s("complete", "profile_completeness_score", "double"), s("last_active", "last_active_date"), s("open", "open_to_work_flag", "boolean"), s("response", "recruiter_response_rate", "double"),
        F.create_map(F.lit("best"), F.col("best")).alias("skill_assessment_scores"), s("notice", "notice_period_days", "int"), s("willing", "willing_to_relocate", "boolean"),
        s("code", "github_activity_score", "double"), s("saved", "saved_by_recruiters_30d", "int"), s("interview", "interview_completion_rate", "double"), s("email", "verified_email", "boolean"), s("linked", "linkedin_connected", "boolean"),
    ))
    drop_pos = lambda a, names: F.transform(a, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    return people.select(
        c.alias("c_custkey"), F.format_string("CAND_%07d", c).alias("candidate_id"), profile.alias("profile"),
        drop_pos("c", ("company", "title", "start_date", "end_date", "duration_months", "is_current", "industry", "company_size", "description")).alias("career_history"),
        drop_pos("s", ("name", "proficiency", "endorsements", "duration_months")).alias("skills"), behaviour.alias("signals"),
    )


#: The same people as flat tables: prof, car (spells), ski (skills), sig (signals), txt (texts).
SQL = r"""
WITH lq AS (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS qty FROM lineitem GROUP BY 1),
oall AS (
  SELECT *, coalesce(qty, 0) AS q FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders) x
  LEFT JOIN lq ON l_orderkey = o_orderkey
),
car AS (
  SELECT c_custkey AS id, pos, o_orderpriority AS company, o_orderstatus || ' ' || o_orderpriority AS title, CAST(o_orderdate AS DATE) AS a, b, industry,
         CAST(CASE WHEN b IS NULL THEN (2024 - year(o_orderdate)) * 12 + 3 - month(o_orderdate) ELSE q // 3 + CASE WHEN o_orderkey % 23 = 0 THEN 20 ELSE 0 END END AS INT) AS months,
         cur, o_orderpriority || ' order ' || o_orderkey AS description
  FROM (SELECT *, o_orderstatus AS industry, o_orderstatus = 'O' AS cur,
               CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_orderdate AS DATE) + 30 WHEN o_orderstatus = 'O' THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN CAST(o_orderdate AS DATE) - 40 ELSE CAST(o_orderdate AS DATE) + q * 10 END AS b FROM oall) y
  JOIN customer ON c_custkey = o_custkey
),
ski AS (
  SELECT o_custkey AS id, pos, lower(p_name) AS name, CASE l_linenumber % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' ELSE 'expert' END AS proficiency,
         CAST(l_quantity AS INT) % 20 AS endorsements, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE p_size END AS months
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
  JOIN part ON p_partkey = l_partkey
),
sig AS (
  SELECT user_id AS id, least(100.0, count(*))::DOUBLE AS complete, CAST(max(ts) AS DATE) AS last_active, count(*) % 2 = 1 AS open, count(*) % 3 = 0 AS willing,
         round((count(*) FILTER (event_type = 'click'))::DOUBLE / count(*), 3) AS response, CAST(max(event_id) % 120 AS INT) AS notice,
         CASE WHEN count(*) FILTER (event_type = 'purchase') < 10 THEN -1.0 ELSE 6.0 * count(*) FILTER (event_type = 'purchase') END::DOUBLE AS code,
         count(*) FILTER (event_type = 'view') AS saved, round((count(*) FILTER (event_type = 'view'))::DOUBLE / count(*), 3) AS interview,
         count(*) FILTER (event_type = 'signup') % 2 = 0 AS email, count(*) FILTER (event_type = 'error') % 2 = 0 AS linked, (count(*) FILTER (event_type = 'error'))::DOUBLE AS best
  FROM events GROUP BY 1
),
prof AS (
  SELECT c_custkey AS id, printf('CAND_%07d', c_custkey) AS candidate_id, lower(c_mktsegment) || ' ' || lower(n_name) AS headline, lower(coalesce(text, '')) AS summary,
         lower(n_name) AS location, lower(r_name) AS country, CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE (c_custkey * 7 % 310) / 10.0 END::DOUBLE AS years,
         lower(CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment WHEN 2 THEN c_mktsegment || ' engineer' ELSE c_mktsegment || ' lead' END) AS own_title
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN documents ON doc_id = c_custkey
),
st AS (SELECT id, string_agg(name, ' ' ORDER BY pos) AS t FROM ski GROUP BY 1),
ct AS (SELECT id, string_agg(lower(title || ' ' || description), ' ' ORDER BY pos) AS t, string_agg(lower(description), ' ' ORDER BY pos) AS d, count(*) AS n, sum(months) AS months FROM car GROUP BY 1),
txt AS (
  SELECT prof.*, coalesce(st.t, '') AS skills_text, coalesce(ct.t, '') AS career_text, coalesce(ct.d, '') AS description_text, coalesce(ct.n, 0) AS spells, coalesce(ct.months, 0) AS worked,
         headline || ' ' || summary || ' ' || coalesce(ct.t, '') AS trajectory_text,
         coalesce(st.t, '') || ' ' || headline || ' ' || summary || ' ' || coalesce(ct.t, '') AS full_text,
         coalesce((SELECT lower(title) FROM car WHERE car.id = prof.id AND pos = 1), '') AS first_title,
         CASE WHEN own_title <> '' THEN own_title ELSE coalesce((SELECT lower(title) FROM car WHERE car.id = prof.id AND pos = 1), '') END AS current_title
  FROM prof LEFT JOIN st ON st.id = prof.id LEFT JOIN ct ON ct.id = prof.id
)
"""


def hits(column: str, values: tuple[str, ...]) -> str:
    """SQL: terms that a column contains."""
    return "(" + " + ".join(f"contains({column}, '{v.lower()}')::INT" for v in values) + ")"


def any_hit(column: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{v.lower()}')" for v in values) + ")"


def words(column: str, values: tuple[str, ...]) -> str:
    """SQL: terms that stand in a column as words."""
    import re

    return "(" + " + ".join(rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_]){re.escape(v.lower())}($|[^\p{{L}}\p{{N}}_])')::INT" for v in values) + ")"


__all__ = ["REFERENCE", "ROLES", "SKILLS", "SPEC", "SQL", "any_hit", "candidates", "hits", "profile_ddl", "words"]
