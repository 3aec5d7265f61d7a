"""Operators on small fixtures with values worked out by hand."""

import datetime
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions import text as tx
from sieveline.functions.dates import any_date, day, whole_months
from sieveline.functions.vectors import cosine
from sieveline.operators import compare, explain, families, features, intervals, pool, ranking, retrieval, taxonomy, validate
from sieveline.operators import extract as ex
from sieveline.plans import rankings
from sieveline.schema import profile_ddl
from sieveline.sources import readers, writers
from sieveline.streaming.arrivals import arriving_profiles, keep_best


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def person(cid, title="ML Engineer", years=6.0, jobs=(), skills=(), signals=None, location="Pune", country="India"):
    return {
        "candidate_id": cid,
        "profile": {"headline": "search and ranking", "summary": "retrieval", "location": location, "country": country, "years_of_experience": years, "current_title": title},
        "career_history": [{"company": c, "title": t, "start_date": a, "end_date": b, "duration_months": m, "is_current": b is None, "description": d} for c, t, a, b, m, d in jobs],
        "skills": [{"name": n, "proficiency": p, "endorsements": e, "duration_months": m} for n, p, e, m in skills],
        "signals": signals,
    }


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    rows = [
        person("CAND_0000001", jobs=[("Acme", "ML Engineer", "2020-01-01", None, 77, "ranking in production")], skills=[("Python", "expert", 12, 24), ("FAISS", "advanced", 0, 0), ("Qdrant", "expert", 40, 48)],
               signals={"profile_completeness_score": 90, "github_activity_score": 50, "verified_email": True, "linkedin_connected": True, "recruiter_response_rate": 0.5, "open_to_work_flag": True, "notice_period_days": 45, "last_active_date": "2026-05-20", "saved_by_recruiters_30d": 20, "interview_completion_rate": 1.0}),
        person("CAND_0000002", title="HR Manager", years=0.0, jobs=[("TCS", "HR", "2020-05-10", "2020-01-01", 10, "hiring"), ("Infosys", "HR", "2010-01-01", "2012-01-01", 24, "")], skills=[("Python", "expert", 0, 0)] * 3,
               signals={"github_activity_score": -1}, location="Berlin", country="Germany"),
        person("CAND_0000003", title=None, years=4.99, jobs=[], skills=[], signals=None, location=None, country=None),
    ]
    path = tmp_path_factory.mktemp("people") / "people.jsonl"
    path.write_text("\n".join([json.dumps(rows[0]), "", "{broken", json.dumps(rows[1]), json.dumps(rows[2])]) + "\n", encoding="utf-8")
    return readers.profiles(spark, str(path))


def test_reader_drops_malformed_lines(people):
    assert sorted(r.candidate_id for r in people.collect()) == ["CAND_0000001", "CAND_0000002", "CAND_0000003"]


def test_relative_features(people):
    got = {r.candidate_id[-1]: r for r in features.relative_features(people, specs.AI_ENGINEER).collect()}
    a, b, c = got["1"], got["2"], got["3"]
    assert a.title_similarity == 1.0 and a.seniority_alignment == 1.0 and a.location_fit == 1.0 and c.location_fit == 0.25
    assert a.specialist_skill_bonus == pytest.approx(2 / 3) and a.skill_coverage == pytest.approx(0.1)
    assert a.quality_score == pytest.approx(0.9 + 0.5 + 1.0) and b.quality_score == pytest.approx(0.5 - 0.01)
    assert a.hireability_score == pytest.approx(0.15 + 0.2 + 0.15 + 0.075 + 0.1 + 0.1)
    assert b.startup_readiness == 0.0 and a.startup_readiness == 1.0 and c.behavioral_reliability == 0.5
    assert b.years_of_experience == pytest.approx(34 / 12) and b.offdomain_title_penalty == 1.0
    assert c.seniority_alignment == pytest.approx(1 - 0.01 / 5) and c.current_title == ""
    assert a.keyword_trap_penalty == 0.0


@pytest.mark.parametrize(("years", "want"), [(0, 0.0), (4.99, 0.998), (5, 1.0), (9, 1.0), (9.01, 1 - 0.01 / 12), (21, 0.0), (30, 0.0)])
def test_seniority(spark, years, want):
    assert one(spark, features.seniority_alignment(F.lit(float(years)), 5.0, 9.0))[0] == pytest.approx(want)


@pytest.mark.parametrize(("months", "endorsed", "want"), [(0, 0, 0.25), (24, 12, 1.0), (48, 40, 1.0), (12, 0, 0.475), (None, 6, 0.4)])
def test_skill_trust(spark, months, endorsed, want):
    s = F.struct(F.lit(months).cast("int").alias("duration_months"), F.lit(endorsed).alias("endorsements"))
    assert one(spark, features.skill_trust(s))[0] == pytest.approx(want)


def test_integrity_rules(people):
    got = {r.candidate_id[-1]: (r.honeypot, r.honeypot_reasons) for r in features.integrity(people, "2026-05-27").collect()}
    assert got["1"] == (0.0, "") and got["3"] == (0.0, "")
    assert got["2"] == (1.0, "end_before_start,expert_without_use,months_unlike_dates")


@pytest.mark.parametrize(("text", "term", "inside", "word"), [("html", "ml", True, False), ("research", "search", True, False), ("next.js dev", "next.js", True, True), ("nextxjs", "next.js", False, False), ("ui/ux lead", "ui", True, True), ("café ml", "ml", True, True), ("éml", "ml", True, False)])
def test_matching_modes(spark, text, term, inside, word):
    r = one(spark, tx.any_in(F.lit(text), [term]), tx.has_word(F.lit(text), term))
    assert (r[0], r[1]) == (inside, word)


def test_dates(spark):
    now = F.lit("2024-06-15").cast("date")
    d = datetime.date
    for text, want in [("2020-03-05", d(2020, 3, 5)), ("Jan 2019", d(2019, 1, 1)), ("2018", d(2018, 1, 1)), ("03/2017", d(2017, 3, 1)), ("present", d(2024, 6, 15)), ("Jan 2019 - Mar 2020", d(2020, 3, 1)), ("nonsense", None), ("", None)]:
        assert one(spark, any_date(F.lit(text), now))[0] == want, text
    assert one(spark, whole_months(day(F.lit("2020-01-31")), day(F.lit("2020-02-01T00:00"))))[0] == 1
    assert one(spark, day(F.lit("20x0")))[0] is None


def test_months_of_ranges(spark):
    now = F.lit("2024-06-15").cast("date")
    for a, b, want in [("Jan 2020", "Mar 2020", 2), ("2020", "2019", 11), ("03/2018", "05/2019", 14), ("x", "2020", 0), ("Jan 2024", "Present", 5)]:
        assert one(spark, ex.month_range(F.lit(a), F.lit(b), now))[0].months == want, (a, b)


def test_vectors(spark):
    assert one(spark, cosine(F.array(F.lit(3.0), F.lit(4.0)), [3.0, 4.0]))[0] == pytest.approx(1)
    assert one(spark, cosine(F.array(F.lit(0.0), F.lit(0.0)), [3.0, 4.0]))[0] == 0


def test_lexical_scores_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "gamma"), (4, "alpha beta beta")], "id long, text string")
    got = {r.id: r.lexical for r in retrieval.lexical_scores(df, "id", "text", "alpha").collect()}
    assert got[1] == got[4] > 0 and got[2] == got[3] == 0
    idf = lambda n: math.log(6 / (1 + n)) + 1
    assert got[1] == pytest.approx(idf(3) / math.hypot(idf(3), 2 * idf(2)), abs=1e-9)


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, s int")
    got = {r.id: r.rank for r in ranking.global_rank(df, [("s", True), ("id", False)]).collect()}
    want = sorted(range(50), key=lambda i: (-(i % 3), i))
    assert [got[i] for i in want] == list(range(50))
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    assert [r.u for r in ranking.with_min_max(flat, "x", "u", flat=0.5).collect()] == [0.5, 0.5]
    assert ranking.global_rank(df.filter("1 = 0"), [("s", True)]).count() == 0


def test_interval_merge(spark):
    d = datetime.date
    rows = [(1, d(2020, 1, 1), d(2020, 2, 1)), (1, d(2020, 2, 1), d(2020, 3, 1)), (1, d(2020, 1, 10), d(2020, 1, 12)), (1, d(2021, 1, 1), d(2021, 1, 2)), (2, d(2020, 1, 1), d(2020, 1, 5)), (2, d(2020, 1, 1), d(2020, 1, 5))]
    got = {r.k: (r.covered_days, r.islands) for r in intervals.covered_days(spark.createDataFrame(rows, "k int, a date, b date"), ["k"], "a", "b").collect()}
    assert got == {1: (61, 2), 2: (4, 1)}


def test_promotions(spark):
    rows = [(1, "A", "dev", 1), (1, "B", "dev", 2), (1, "a", "lead", 3), (1, "A", "lead", 4)]
    got = intervals.promotions(spark.createDataFrame(rows, "k int, c string, t string, o int"), ["k"], "c", "t", "o", "o").first()
    assert (got.promotions, got.companies) == (1, 2)


def test_trajectories(spark):
    e = lambda a, b, c="x", i="": {"title": "t", "company": c, "industry": i, "start_date": a, "end_date": b}
    rows = [
        (1, [e("2020-01-01", "2024-01-01")], 0), (2, [e("2020-01-01", "2021-01-01", "a"), e("2021-01-01", "2022-01-01", "b"), e("2022-01-01", "2023-01-01", "c")], 0),
        (3, [e("2020-01-01", "2022-01-01")], 1), (4, [], 0), (5, [e("?", None)], 0),
    ]
    df = spark.createDataFrame(rows, "k int, jobs array<struct<title string, company string, industry string, start_date string, end_date string>>, ups int".replace(" string", ":string"))
    got = {r.k: r.archetype for r in intervals.trajectory(df, "jobs", "ups", F.lit("2024-06-01").cast("date")).collect()}
    assert got == {1: "mixed", 2: "chaotic_hopper", 3: "fast_climber", 4: "unknown", 5: "unknown"}


def test_families_first_maximum(spark):
    got = one(spark, families.best_family(F.lit("sales search"), specs.ROLE_FAMILIES), families.best_family(F.lit("nothing"), specs.ROLE_FAMILIES))
    assert tuple(got) == ("Search Engineer", "Unknown")
    assert families.job_family("Growth lead") == "Sales Manager" and families.job_family("?") == "Search Engineer"


def test_family_rankings(people):
    frozen = rankings.frozen_ranking(people, specs.POOL_SEARCH).collect()
    scaled = rankings.scaled_ranking(people, specs.POOL_SEARCH).collect()
    assert [r.rank for r in frozen] == [1, 2, 3] and frozen[0].candidate_id == scaled[0].candidate_id == "CAND_0000001"
    assert all(0 <= r.final_score <= 100 for r in scaled)
    assert all(b.final_score <= a.final_score for a, b in zip(frozen, frozen[1:], strict=False))


def test_pool_ranking_with_model(people):
    wide = pool.pool_features(people)
    best = pool.packed(pool.model_score(wide, lambda df: df["semantic_sim"] * 2), 2).collect()
    assert [r.rank for r in best] == [1, 2] and best[0].final_score == 100.0
    steps = wide.select(pool.career_steps().alias("s"), pool.percent_features().alias("p")).collect()
    assert steps[0].s[0].year == 2020 and 0 <= steps[0].p.quality_score <= 100
    scores = people.select(F.col("candidate_id").alias("id"), F.lit(0.9).alias("cosine"), F.lit(0.8).alias("share"))
    assert {r.semantic_sim for r in pool.with_real_scores(wide, scores).collect()} == {0.9}


def test_relative_ranking_and_reasons(spark, people):
    vectors = spark.createDataFrame([("CAND_0000001", [1.0, 0.0]), ("CAND_0000002", [0.0, 1.0])], "id string, embedding array<float>")
    got = rankings.relative_ranking(people, vectors, [1.0, 0.0], "retrieval ranking search", specs.AI_ENGINEER).collect()
    assert [r.candidate_id for r in got] == ["CAND_0000001", "CAND_0000003", "CAND_0000002"] and got[0].score == 1.0
    assert got[0].reasoning == "ML Engineer with 6.0 yrs' experience. Strong retrieval/ranking profile matching the AI-engineer JD. Relevant skills: Python, FAISS, Qdrant. Signals: 50% recruiter response, open to work, 45d notice."
    assert "off-domain" in got[2].reasoning and got[1].reasoning.startswith("5.0-year professional.")


def test_showcase(people):
    ranked = rankings.showcase_ranking(people).collect()
    assert ranked[0].final_score == 86.0 and ranked[1].final_score == 85.0


def test_taxonomy(spark):
    rows = [("Python", ["py", "python3"], "lang", 0), ("Machine Learning", ["ml"], "ai", 1), ("Vector Search", [], "ai", 2)]
    known = taxonomy.aliases(spark.createDataFrame(rows, "canonical string, aliases array<string>, category string, pos int"))
    names = spark.createDataFrame([("PY ",), ("Pythn",), ("search",), ("cobol",), (None,), ("machine learning",)], "name string")
    got = {r.name: (r.canonical, r.method) for r in taxonomy.normalise_names(names, known).collect()}
    assert got == {"PY ": ("Python", "exact"), "Pythn": ("Python", "fuzzy"), "search": ("Vector Search", "subset"), "cobol": (None, "none"), None: (None, "none"), "machine learning": ("Machine Learning", "exact")}


def test_mentions(spark):
    rows = [(1, "Python", "py", "employment", None, False, 0), (1, "python", "Python", "other", "familiar with it", False, 1), (1, "Go", "go", "certifications", None, False, 2), (1, "C", "c", "skills", None, True, 3)]
    df = spark.createDataFrame(rows, "k int, canonical string, name string, source_section string, context string, negated boolean, pos int")
    got = {r.canonical: r for r in taxonomy.merge_mentions(df, ["k"]).collect()}
    assert got["python"].confidence == 0.86 and got["python"].name == "py" and got["python"].sections == "experience,skills"
    assert got["go"].confidence == 1.0 and got["c"].confidence == 0.0 and not got["c"].eligible
    hints = spark.createDataFrame([(0.8,), (0.3,)], "x double")
    assert hints.agg(taxonomy.noisy_or(F.col("x"))).first()[0] == 0.86


def test_extraction(spark):
    text = "Jane Doe\njane.doe@mail.org | +49 (170) 123-4567\nExperience:\nLead Engineer - Acme\nSkills\nKubernetes and machine learning\nEducation: B.Tech in X"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    r = df.filter("id = 1").select(ex.email(F.col("text")), ex.phone(F.col("text")), ex.wanted_years(F.lit("needs 7+ years of experience")), ex.wanted_years(F.lit("senior")), ex.degrees(F.lit("B.Tech, PhD"))).first()
    assert (r[0], r[1], r[2], r[3]) == ("jane.doe@mail.org", "+49 (170) 123-4567", 7, 5) and {"PhD", "BTech"} <= set(r[4])
    lines = [(x.section, x.line) for x in ex.sections(df, "id", "text").orderBy("id", "pos").collect()]
    assert lines == [("Summary", "Jane Doe"), ("Summary", "jane.doe@mail.org | +49 (170) 123-4567"), ("Experience", "Lead Engineer - Acme"), ("Skills", "Kubernetes and machine learning"), ("Education", "B.Tech in X")]
    assert {x.skill for x in ex.compound_skills(df, "id", "text").collect()} == {"kubernetes", "machine learning"}
    assert ex.name_candidates(df, "id", "text").first().name == "Jane Doe"
    assert one(spark, ex.clean_title(F.lit("Acme - Senior Engineer - Berlin")))[0] == "Senior Engineer"
    assert tuple(one(spark, ex.is_role_title(F.lit("Data Scientist")), ex.is_role_title(F.lit("Seeking a developer job")))) == (True, False)


@pytest.mark.parametrize(("alias", "text", "match"), [
    ("c", "abc", ""), ("c", "a, c, b", "c"), ("c", "a, C, b", ""), ("go", "x (GO)", "GO"), ("go", "ago", ""), ("node.js", "in nodejs now", "nodejs"), ("node.js", "nodeXjs", ""),
    ("e-mail", "an e mail", "e mail"), ("e-mail", "emails email", "email"), ("java", "javascript", ""), ("java", "Java.", "Java"), ("aws", "first\naws", "aws"), ("c++", "c, c++.", "c++"),
])
def test_alias_pattern(spark, alias, text, match):
    from sieveline.operators import parsing

    assert one(spark, F.call_function("regexp_extract", F.lit(text), parsing.alias_pattern(F.lit(alias)), F.lit(0)))[0] == match


def test_assembled_record(spark):
    from sieveline.operators import parsing
    from sieveline.operators.titles import TITLES

    text = "Jane Doe\njane@mail.org\nSummary\nBuilds things.\nExperience\nLead Engineer at Acme\nJan 2015 - Dec 2018\nAnalyst at Acme\nJan 2012 - Dec 2014\nEducation\nPhD, Harbour School\nSkills\nKubernetes, go"
    df = spark.createDataFrame([(1, text), (2, None)], "doc long, body string")
    aliases = spark.createDataFrame([("Go", ["golang", "go"], "code", 0)], "canonical string, aliases array<string>, category string, pos int")
    titles = spark.createDataFrame([("lead engineer", "Engineering Lead")], "alias string, canonical string")
    fixed = spark.createDataFrame(list(TITLES.items()), "alias string, canonical string")
    a, b = parsing.assembled_records(df, "doc", "body", aliases, titles, fixed, F.lit("2024-01-01").cast("date")).orderBy("id").collect()
    assert (a.full_name, a.current_title, a.summary, a.contact.email) == ("Jane Doe", "Engineering Lead", "Jane Doe jane@mail.org Builds things.", "jane@mail.org")
    assert [e.title for e in a.career_history] == ["Lead Engineer", "Analyst"] and a.career_graph.leadership_years == 3 and a.career_graph.promotion_count == 1 and a.career_graph.company_count == 1
    assert {s.skill for s in a.skills} == {"Kubernetes", "Go"} and a.education[0].degree == "PhD" and a.education[0].institution == "Harbour School"
    assert 0 < a.overall_confidence <= 1 and a.title_confidence == 0.95 and a.skill_confidence == 0.1
    assert b.career_history is None and b.overall_confidence == 0.0 and b.current_employment_status == "Unknown"


def test_jobs_from_parsed_needs():
    from sieveline.operators import families

    spec = families.spec_of_job({"title": "Sales Lead", "required_hard_skills": ["CRM"], "required_soft_skills": ["talk"], "preferred_skills": ["tea"]})
    assert spec.title_terms == ("Sales Lead", "Sales", "Lead") and spec.req_skills == ("CRM",) and spec.keywords == ("talk", "tea")
    assert families.spec_of_job({"family": "X", "title_terms": ["a"], "req_skills": ["b"], "keywords": ["c"]}).title_terms == ("a",)
    assert families.required_skills({"required_hard_skills": ["A", "b"], "required_soft_skills": ["a"]}) == ("a", "b")


def test_models_passed_in(spark):
    import numpy as np

    from sieveline.operators import retrieval

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(7)], "id long, text string")
    got = retrieval.encoded(df, "id", "text", lambda texts: np.array([[len(x), 1 / 3] for x in texts]), batch=2).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == list(range(7)) and got[0].embedding[1] == float(np.float16(1 / 3))
    best = retrieval.reranked(df, "q", "text", lambda qs, texts: np.array([len(x) % 5 for x in texts]), "id", k=3).collect()
    assert [r.id for r in best] == [4, 3, 2]


def test_baseline_file(spark, tmp_path):
    from sieveline.sources import writers

    ranked = spark.createDataFrame([(2, "b", 0.5), (1, "a", 0.9)], "rank int, candidate_id string, score double")
    writers.write_baseline(ranked, spark.createDataFrame([(0.0, 97.0)], "trap double, consistent double"), "Job", str(tmp_path / "base"))
    row = spark.read.json(str(tmp_path / "base")).first()
    assert row.job == "Job" and [x.candidate_id for x in row.top] == ["a", "b"] and row.metrics.consistent == 97.0


def test_match_dimensions(spark):
    c = {
        "required": F.array(F.lit("a"), F.lit("b"), F.lit("c")), "skills": F.array(F.lit("a")), "title": F.lit("senior dev"), "wanted_title": F.lit("dev"), "years": F.lit(3.0), "wanted_years": F.lit(5.0),
        "domain": F.lit("x"), "wanted_domain": F.lit("y"), "archetype": F.lit("fast_climber"), "has_education": F.lit(False), "wants_education": F.lit(True), "has_certification": F.lit(True),
        "wants_certification": F.lit(True), "has_projects": F.lit(False), "is_current": F.lit(True), "transferable": F.lit(2),
    }
    assert list(one(spark, *compare.match_dimensions(c).values())) == [33, 80, 60, 0, 60, 100, 70, 100, 100, 80]


def test_validator(spark):
    rows = [(f"CAND_{i:07d}", str(i), f"{1 - i / 200:.4f}", "x") for i in range(1, 101)]
    schema = "candidate_id string, rank string, score string, reasoning string"
    assert validate.ranking_problems(spark.createDataFrame(rows, schema)).count() == 0
    rows[5] = ("BAD", "7", "0.99999", "x")
    assert {r.problem for r in validate.ranking_problems(spark.createDataFrame(rows, schema)).collect()} == {"bad_id", "repeated_rank", "score_rises"}


def test_quality_of_ranking(spark):
    got = validate.composite_quality(spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "rank int, relevance int")).first()
    assert got.average_precision == pytest.approx((1 + 2 / 3) / 2) and got.p5 == pytest.approx(0.4) and got.ndcg10 == pytest.approx(1.5 / (1 + 1 / math.log2(3)))


def test_writers_and_readers(spark, people, tmp_path):
    ranked = spark.createDataFrame([("CAND_0000001", 1, 1.0, 'say "hi", twice', "Jane"), ("CAND_0000002", 2, 0.25, "x", "Joe")], "candidate_id string, rank int, score double, reasoning string, name string")
    writers.ranked_csv(ranked, str(tmp_path / "csv"))
    back = readers.submission(spark, str(tmp_path / "csv")).collect()
    assert [(r.rank, r.score, r.reasoning) for r in back] == [("1", "1.0000", 'say "hi", twice'), ("2", "0.2500", "x")]
    assert writers.text_report(ranked.withColumn("score", F.col("score") * 100)).first().report == "1. Jane (100)\n2. Joe (25)"
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "k int, at int, gone boolean")
    assert [r.k for r in writers.current_versions(log, ["k"], "at", "gone").collect()] == [2]
    assert writers.with_missing_columns(log, {"k": "int", "more": "string"}).columns == ["k", "at", "gone", "more"]
    (tmp_path / "t.json").write_text('{"Python": {"aliases": ["py"], "category": "lang"}}')
    assert readers.taxonomy(spark, str(tmp_path / "t.json")).first().canonical == "Python"
    for folder, name in (("a", "X.docx"), ("b", "x.DOCX"), ("b", "y.docx"), ("b", "z.exe")):
        (tmp_path / folder).mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / folder / name, "w") as z:
            z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:document>')
    files = readers.uploads(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    got = files.select("name", readers.docx_text("content").alias("d")).orderBy("name").collect()
    assert [(r.name, r.d.text) for r in got] == [("x.docx", "Hello"), ("y.docx", "Hello")]
    assert readers.first_path(spark, [str(tmp_path / "no"), str(tmp_path / "a"), "z"]) == str(tmp_path / "a")


def test_regression_and_pairs(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.5)], "rank int, id string, score double")
    b = spark.createDataFrame([(1, "a", 1.0 + 1e-7), (2, "c", 0.5), (3, "d", 0.1)], "rank int, id string, score double")
    assert sorted(r.rank for r in compare.regression(a, b).collect()) == [2, 3]


def test_arrivals(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    score = lambda df: df.select("candidate_id", F.col("profile.years_of_experience").alias("score"))
    for n in range(2):
        (src / f"{n}.json").write_text("\n".join(json.dumps(person(f"CAND_00000{n}{i}", years=float(i + 10 * n))) for i in range(5)))
        keep_best(arriving_profiles(spark, str(src)), score, str(tmp_path / "out"), str(tmp_path / "check"), k=3).awaitTermination()
    best = spark.read.parquet(str(tmp_path / "out/best-1")).collect()
    assert sorted(r.score for r in best) == [12.0, 13.0, 14.0]


def test_concern_percent(spark):
    assert one(spark, tx.percent(F.lit(0.125)), tx.percent(F.lit(0.175)))[0] == "12%"
    assert explain.match_explanation is not None and profile_ddl("behaviour").count("behaviour STRUCT") == 1


def test_array_vectors_and_texts(spark, tmp_path):
    import json

    from sieveline.sources import readers, writers

    (tmp_path / "a.json").write_text(json.dumps([{"candidate_id": "CAND_0000001"}, {"candidate_id": "CAND_0000002", "skills": [{"name": "Go"}]}]))
    got = readers.profile_array(spark, str(tmp_path / "a.json")).orderBy("candidate_id").collect()
    assert [r.candidate_id for r in got] == ["CAND_0000001", "CAND_0000002"] and got[1].skills[0].name == "Go"
    df = spark.createDataFrame([("x", [1.0, 2.0])], "id string, embedding array<double>")
    writers.write_vectors(df, str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v"), "id").first().embedding == [1.0, 2.0]
    assert readers.query_vector(spark, str(tmp_path / "v")) == [1.0, 2.0]
    assert readers.query_vector(spark, str(tmp_path / "none"), encode=lambda t: [len(t)], text="abc") == [3.0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.query_vector(spark, str(tmp_path / "none"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_bytes("gr\u00fcn".encode() + b"\xff")
    assert readers.texts(spark, str(tmp_path / "t")).first().text == "gr\u00fcn"
    log = str(tmp_path / "log")
    for at, gone in ((1, False), (2, False), (3, True)):
        writers.append_version(spark.createDataFrame([("k", at, gone)], "id string, at int, gone boolean"), log)
    assert writers.current_versions(spark.read.parquet(log).filter("at < 3"), ["id"], "at", "gone").first()["at"] == 2
    assert writers.current_versions(spark.read.parquet(log), ["id"], "at", "gone").count() == 0
    writers.audit_event(spark.range(2), F.lit("seen"), F.current_timestamp(), str(tmp_path / "audit"))
    assert {r.action for r in spark.read.json(str(tmp_path / "audit")).collect()} == {"seen"}


def test_uploads_are_chosen_before_they_are_read(spark, tmp_path):
    from sieveline.sources import readers

    for folder, name, size in (("a", "CV.pdf", 5), ("b", "cv.pdf", 6), ("b", "x.docx", 7), ("b", "big.png", 50), ("b", "y.exe", 1)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"x" * size)
    got = {r.name: (len(r.content), r.folder) for r in readers.uploads(spark, [str(tmp_path / "a"), str(tmp_path / "b")], limit=20).collect()}
    assert got == {"cv.pdf": (5, 0), "x.docx": (7, 1)}


def test_a_model_that_fails(spark):
    from sieveline.operators import pool

    row = {c: float(i) for i, c in enumerate(dict.fromkeys([*pool.MODEL_COLUMNS, *pool.specs.POOL_WEIGHTS]))}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))

    def broken(columns):
        raise RuntimeError("no model")

    linear = pool.linear_score(df).first().pool_score
    assert pool.model_score(df, broken).first().pool_score == linear
    assert pool.model_score(df, lambda c: c["semantic_sim"] + 5).first().pool_score == row["semantic_sim"] + 5


def test_refusals(spark):
    from sieveline.operators import compare, validate

    two = spark.range(2).selectExpr("id AS x")
    with pytest.raises(ValueError, match="one row"):
        compare.head_to_head(two, two.limit(1), ["x"])
    same = spark.range(4).selectExpr("'a' AS candidate_id", "'1' AS rank", "'1' AS score", "'r' AS reasoning")
    assert {tuple(r) for r in validate.ranking_problems(same).collect()} == {("row_count", 1), ("bad_id", 4), ("repeated_id", 3), ("repeated_rank", 3)}
