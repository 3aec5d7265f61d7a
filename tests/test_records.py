"""Records and display rows against hand-made values."""

from pyspark.sql import functions as F

from sieveline.operators import records


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_career_blocks(spark):
    text = "Experience\nSenior Engineer at Acme Jan 2020 - Present\nbuilt things\nBeta Ltd\nData Analyst\nMar 2018 – Dec 2019\nno dates"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = records.career_blocks(df, "id", "text", F.lit("2021-01-15").cast("date")).orderBy("pos").collect()
    assert [(r.title, r.company, r.months, r.is_current, r.confidence) for r in got] == [("Senior Engineer", "Acme", 12, True, 1.0), ("Data Analyst", "Beta Ltd", 21, False, 1.0)]


def test_career_blocks_in_full(spark):
    text = "Acme - Lead Engineer\n01/2018 - 03/2020\n\nAnalyst\n2016 to 2017\nSeeking a role in sales\nMay 2010 – Jan 2009"
    bare = "Backend Developer at Beta\nCook of soups\nDevOps Engineer"
    df = spark.createDataFrame([(1, text), (2, bare), (3, ""), (4, None)], "id long, text string").withColumn("title", F.lit("clash"))
    got = records.career_blocks(df, "id", "text", F.lit("2021-01-15").cast("date")).orderBy("id", "pos").collect()
    a, b, c, d, e = got
    assert (a.title, a.company, a.inverted, a.months, a.bullets, a.confidence) == ("Lead Engineer", "Acme", True, 26, ["Analyst"], 1.0)
    assert (b.title, b.company, b.inverted, b.evidence[-1]) == ("Analyst", "Acme", False, "Valid dates: 2016 - 2017")  # the company of the range before
    assert (c.title, c.months, c.confidence) == ("Seeking a role in sales", 1, 0.9) and c.evidence[0].startswith("Title found")
    assert (d.id, d.title, d.company, d.confidence, d.start_date) == (2, "Backend Developer", "Beta", 0.6, "") and (e.title, e.company, e.confidence) == ("DevOps Engineer", "", 0.5)


def test_names_are_scored(spark):
    from sieveline.operators import extract as ex

    texts = [
        "Curriculum Vitae\nJANE DOE | Engineer\nDallas, TX\njane@x.org", "Data Scientist\nAcme Street 5\nsoup, hot\nMary Ann Smith - PhD\nlinkedin.com/in/mary", "Experience\nhttp://x.org", "x" * 300 + "\nAl Bo",
    ]
    got = {r.id: (r.name, r.score) for r in ex.name_candidates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    assert got[0] == ("JANE DOE", 100 - 5 + 30 + 15 + 15) and got[1][0] == "Mary Ann Smith" and got[1][1] == 100 - 15 + 30 + 20 and 2 not in got
    assert one(spark, ex.name_confidence(F.lit(155)))[0] == 1.0 and one(spark, ex.name_confidence(F.lit(-5)))[0] == 0.0
    assert tuple(one(spark, ex.raw_text_kept(F.lit("t"), F.lit(0.79)), ex.raw_text_kept(F.lit("t"), F.lit(0.8)))) == ("t", "")


def test_certificates(spark):
    got = one(spark, records.certificates(F.lit("holder of the aws certified developer badge, CISSP")))[0]
    assert [c.name for c in got] == ["AWS Certified Developer", "CISSP"] and "badge" in got[0].evidence


def test_titles(spark):
    fixed = spark.createDataFrame([("growth hacker", "Software Engineer")], "alias string, canonical string")
    aliases = spark.createDataFrame([("swe", "Software Engineer"), ("backend developer", "Backend Engineer"), ("developer", "Developer")], "alias string, canonical string")
    names = spark.createDataFrame([("Growth Hacker",), ("SWE",), ("Senior Backend Developer",), ("Cook",), (None,)], "title string")
    got = {r.title: (r.normalised, r.method) for r in records.normalise_titles(names, "title", fixed, aliases).collect()}
    assert got == {"Growth Hacker": ("Software Engineer", "hardcoded"), "SWE": ("Software Engineer", "alias"), "Senior Backend Developer": ("Backend Engineer", "partial"), "Cook": ("Cook", "none"), None: (None, "none")}


def test_titles_with_family(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "alias string, canonical string")
    about = spark.createDataFrame([("Software Engineer", "engineering", "mid")], "canonical string, family string, seniority string")
    got = records.normalise_titles(spark.createDataFrame([("swe",), ("Cook",)], "title string"), "title", pairs([("a", "b")]), pairs([("swe", "Software Engineer")]), about=about).collect()
    assert {(r.title, r.family, r.seniority) for r in got} == {("swe", "engineering", "mid"), ("Cook", "", "")}


def test_record_remap(spark):
    from sieveline.schema import profile_ddl

    row = '{"candidate_id":"CAND_0000001","profile":{"anonymized_name":"Jo","headline":"H","current_title":"T","years_of_experience":3.5},"skills":[{"name":"Go"}],"career_history":[{"title":"T"}]}'
    df = spark.createDataFrame([(row,)], "v string").select(F.from_json("v", profile_ddl()).alias("p")).select("p.*")
    got = df.select(records.parsed_record("pool").alias("r")).first().r
    assert (got.full_name, got.headline, got.summary, got.total_years_of_experience, got.skills[0].type, got.source, got.external_id) == ("Jo", "H", "", 3.5, "hard", "pool", "CAND_0000001")
    assert got.signals is None and got.career_history[0].title == "T"


def test_texts_for_display(spark):
    skills = F.array(F.struct(F.lit("a").alias("name"), F.lit(0.9).alias("confidence"), F.lit(False).alias("negated")), F.struct(F.lit("b").alias("name"), F.lit(0.5).alias("confidence"), F.lit(False).alias("negated")))
    jobs = F.array(*(F.struct(F.lit(t).alias("title")) for t in ("x", "y")))
    assert one(spark, records.encoder_text(F.lit("S"), F.lit("T"), skills, jobs, F.array(F.lit("q"))))[0] == "S. Current: T. Skills: a. Recent roles: x → y. Project tech: q"
    assert one(spark, records.text_list(F.lit(" a, ,b")))[0] == ["a", "b"]
    assert one(spark, records.signal_lines(F.lit(0.125), F.lit(None).cast("int")))[0] == ["Response Rate: 13%"]
    assert one(spark, records.signal_lines(F.lit(None).cast("double"), F.lit(None).cast("int")))[0] == ["Response Rate: 0%", "Notice Period: 30 days"]
    low = one(spark, records.display_row(F.lit("Jo"), F.lit(29.4), F.lit(2.0), F.array(F.lit("m")), F.array(F.lit("k"))))[0]
    assert (low.match_score, low.is_low, low.narrative) == (29, True, "Jo scores below the shortlist threshold (29%). Primary gaps: k.")
    assert one(spark, records.keyword_signals(F.lit("Remote AI team"), {"ai": ("ai ",), "none": ("xyz",)}))[0] == ["ai"]
    assert one(spark, records.score_sentence(F.lit(12.345), F.lit(None).cast("string")))[0].endswith("Missing skills: None")
    row = spark.createDataFrame([("ml lead", 3.0, 0.9, 0.5, 0.9, 1.5, 0.0)], "current_title string, years_of_experience double, title_similarity double, skill_coverage double, seniority_alignment double, quality_score double, anti_skill_penalty double")
    assert row.select(records.pool_sentences().alias("s")).first().s.startswith("Ml Lead with 3.0 years of experience. Perfectly aligned")


def test_export_joins_lists(spark, tmp_path):
    from sieveline.sources import writers

    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", [])], "rank int, name string, skills array<string>")
    writers.export_csv(rows, str(tmp_path / "out"), ("skills",))
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("1", "a", "x; y"), ("2", "b", None)]


def test_match_explanation_and_authenticity(spark):
    from sieveline.operators import explain, records

    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    got = spark.range(1).select(
        explain.match_explanation(a("p", "q", "r", "s"), a("t")).alias("both"), explain.match_explanation(a(), a()).alias("none"), records.domain_authenticity(F.lit(25)).alias("some"), records.domain_authenticity(F.lit(250)).alias("least")
    ).first()
    assert tuple(got) == ("Strengths: p, q, r; Gaps: t", "No required skills", 0.75, 0.0)


def test_velocity_of_half_a_tenth(spark):
    """9 promotions in 160 months are 0.675 a year, 6.75 in ten."""
    from sieveline.operators import parsing

    rows = [(1, i, "Analyst" if i % 2 else "Clerk", "Acme", "01/2000", "05/2013" if i == 9 else f"0{i + 1}/2001", 1, False) for i in range(10)]
    blocks = spark.createDataFrame(rows, "id int, pos int, title string, company string, start_date string, end_date string, months int, inverted boolean")
    got = parsing.career_graph(blocks, F.lit("2021-01-15").cast("date")).first()
    assert (got.promotion_count, round(got.total_years * 12), got.career_velocity) == (9, 160, 6.8)


def test_equal_spells_in_any_order(spark, monkeypatch):
    """The rows between the two scans may come back in any order."""
    from sieveline.operators import intervals

    whole = intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda df, name: whole(df.coalesce(1).withColumn("__at", F.monotonically_increasing_id()).orderBy(F.desc("__at")).drop("__at"), name))
    df = spark.createDataFrame([(1, 1, 2), (1, 10, 12), (1, 10, 12), (1, 12, 15), (1, 20, 21)], "k int, a int, b int")
    assert sorted(map(tuple, intervals.merged(df, ["k"], "a", "b").collect())) == [(1, 1, 2, 1), (1, 10, 15, 3), (1, 20, 21, 1)]
