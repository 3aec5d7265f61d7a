"""Registered queries of the library's own operators, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions import text as tx
from sieveline.functions.numbers import clip
from sieveline.operators import compare, families, features, intervals, pool, retrieval, taxonomy, validate
from sieveline.operators import extract as ex
from sieveline.operators import ranking as rk
from sieveline.plans import rankings
from sieveline.plans.candidates import ROLES, SKILLS, SPEC, SQL, any_hit, candidates, hits, words
from sieveline.plans.registry import ORACLES, QUERIES, query, r, t
from sieveline.sources import writers
from sieveline.streaming import arrivals

QUERY = "thatin orantion rewh the que that of nederlet inght and blue ring"


# --- retrieval ------------------------------------------------------------------------------------------

_LEX = rf"""
docs AS (SELECT doc_id AS id, FALSE AS q, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, TRUE, '{QUERY}'),
every AS (SELECT id, q, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs),
toks AS (SELECT * FROM every WHERE term NOT IN ({", ".join(f"'{w}'" for w in tx.english_stop_words())})),
tf AS (SELECT id, q, term, count(*) AS n FROM toks GROUP BY ALL),
voc AS (SELECT term, sum(n) AS ctf, count(*) AS df FROM tf GROUP BY 1 ORDER BY ctf DESC, term LIMIT 5000),
w AS (SELECT id, q, tf.term, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN voc USING (term)),
qw AS (SELECT term, w AS qw FROM w WHERE q),
qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qw),
dn AS (SELECT id, sqrt(sum(w * w)) AS dn, sum(w * coalesce(qw, 0)) AS dot FROM w LEFT JOIN qw USING (term) WHERE NOT q GROUP BY 1),
lex AS (SELECT d.id, coalesce(round(dot / (dn * qn), 10), 0) AS lexical FROM docs d LEFT JOIN dn USING (id) CROSS JOIN qn WHERE NOT d.q)
"""
_DENSE = """
q0 AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
qv AS (SELECT unnest(e)::DOUBLE AS y, generate_subscripts(e, 1) AS i FROM q0),
ev AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
dense AS (SELECT id, round(sum(x * y) / (CASE WHEN sum(x * x) = 0 THEN 1 ELSE sqrt(sum(x * x)) END * (SELECT sqrt(sum(y * y)) + 1e-9 FROM qv)), 10) AS cosine FROM ev JOIN qv USING (i) GROUP BY 1)
"""
_RRF = """
rd AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS rank_dense FROM dense),
rl AS (SELECT *, row_number() OVER (ORDER BY lexical DESC, id) - 1 AS rank_lexical FROM lex),
fused AS (
  SELECT rl.id, coalesce(cosine, 0) AS cosine, lexical, coalesce(rank_dense, (SELECT count(*) FROM lex)) AS rank_dense, rank_lexical,
         round(1.0::DOUBLE / (60 + coalesce(rank_dense, (SELECT count(*) FROM lex))) + 1.0::DOUBLE / (60 + rank_lexical), 12) AS rrf
  FROM rl LEFT JOIN rd ON rd.id = rl.id ORDER BY rrf DESC, rl.id LIMIT 6000
)
"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


def _dense(spark, sf_dir):
    return retrieval.dense_scores(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir))


def _lexical(spark, sf_dir):
    return retrieval.lexical_scores(t(spark, sf_dir, "documents"), "doc_id", "text", QUERY, stop_words=tx.english_stop_words())


@query(f"WITH {_DENSE} SELECT id, round(cosine, 6) AS cosine FROM dense")
def ret1_dense_cosine(spark, sf_dir):
    return _dense(spark, sf_dir).select("id", r("cosine").alias("cosine"))


@query(f"WITH {_LEX} SELECT id, round(lexical, 6) AS lexical FROM lex")
def ret2_lexical_tfidf(spark, sf_dir):
    return _lexical(spark, sf_dir).select("id", r("lexical").alias("lexical"))


@query(f"WITH {_LEX}, {_DENSE}, {_RRF} SELECT id, rank_dense, rank_lexical, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY rrf DESC, id) AS place FROM fused QUALIFY place <= 100")
def ret3_hybrid_rrf(spark, sf_dir):
    fused = retrieval.fuse(_dense(spark, sf_dir), _lexical(spark, sf_dir))
    best = rk.rank_top(rk.top(fused, 100, [("rrf", True), ("id", False)]), [("rrf", True), ("id", False)], "place")
    return best.select("id", "rank_dense", "rank_lexical", r("rrf", 9).alias("rrf"), F.col("place").cast("long"))


@query(f"""WITH {_LEX}, {_DENSE} SELECT id FROM (SELECT id FROM dense ORDER BY cosine DESC, id LIMIT 5000) UNION SELECT id FROM (SELECT id FROM lex ORDER BY lexical DESC, id LIMIT 5000)""")
def ret4_union_of_tops(spark, sf_dir):
    return retrieval.union_of_tops(_dense(spark, sf_dir), _lexical(spark, sf_dir), 5000)


@query(f"WITH {_LEX} SELECT id, round(least(greatest(lexical / ((SELECT quantile_cont(lexical, 0.99) FROM lex) + 1e-9), 0), 1), 5) AS share FROM lex")
def ret5_share_of_p99(spark, sf_dir):
    return rk.with_share_of_percentile(_lexical(spark, sf_dir), "lexical", "share").select("id", r("share", 5).alias("share"))


@query(f"WITH {_LEX}, {_DENSE}, {_RRF} SELECT id, round((rrf - (SELECT min(rrf) FROM fused)) / ((SELECT max(rrf) - min(rrf) FROM fused) + 1e-9), 5) AS retrieval_fusion FROM fused")
def ret6_normalised_fusion(spark, sf_dir):
    fused = retrieval.fuse(_dense(spark, sf_dir), _lexical(spark, sf_dir))
    return rk.with_min_max(fused, "rrf", "retrieval_fusion").select("id", r("retrieval_fusion", 5).alias("retrieval_fusion"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def win1_global_rank(spark, sf_dir):
    return rk.global_rank(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)]).select("o_orderkey", "rank")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top4_top_100(spark, sf_dir):
    return rk.top(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)])


@query("""WITH b AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200),
 s AS (SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER () + 1e-9), 2) AS score FROM b)
 SELECT o_orderkey, score, row_number() OVER (ORDER BY score DESC, o_orderkey)::INT AS rank, CASE WHEN row_number() OVER (ORDER BY score DESC, o_orderkey) - 1 < 14 THEN 86 - (row_number() OVER (ORDER BY score DESC, o_orderkey) - 1)
 WHEN row_number() OVER (ORDER BY score DESC, o_orderkey) - 1 < 24 THEN round(58 - 2.4 * (row_number() OVER (ORDER BY score DESC, o_orderkey) - 15), 1) ELSE greatest(6.0, round(24 - 1.4 * (row_number() OVER (ORDER BY score DESC, o_orderkey) - 25), 1)) END::DOUBLE AS shown FROM s""")
def top5_rank_rounded(spark, sf_dir):
    best = rk.top(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, [("o_totalprice", True), ("o_orderkey", False)])
    scored = rk.with_min_max(best, "o_totalprice", "u", few=True).select("o_orderkey", r("u", 2).alias("score"))
    ranked = rk.rank_top(scored, [("score", True), ("o_orderkey", False)])
    return ranked.withColumn("shown", rk.display_score(F.col("rank") - 1))


# --- filters, joins, sets, aggregates over the relational tables -------------------------------------------

@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'build') AND c_acctbal BETWEEN 1000 AND 5000 AND c_nationkey IN (1, 3, 5, 7)")
def flt_customer_search(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.filter(F.contains(F.lower("c_mktsegment"), F.lit("build")) & F.col("c_acctbal").between(1000, 5000) & F.col("c_nationkey").isin(1, 3, 5, 7)).select("c_custkey", "c_name")


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'processing' WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50")
def flt19_status_of_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("props").isNull(), "processing").when(F.col("event_type") == "error", "failed").otherwise("ready")
    return t(spark, sf_dir, "events").select("event_id", status.alias("status"), k.alias("k")).filter("k >= 50")


@query(SQL + "SELECT id FROM prof WHERE years BETWEEN 3 AND 20 AND (SELECT count(DISTINCT w) FROM ski, (VALUES ('ring'), ('gear')) v(w) WHERE ski.id = prof.id AND contains(name, w)) = 2")
def flt7_has_all_skills(spark, sf_dir):
    c = candidates(spark, sf_dir)
    every = F.forall(tx.terms(("ring", "gear")), lambda q: F.exists(F.coalesce("skills", F.array().cast(c.schema["skills"].dataType)), lambda s: F.contains(F.lower(s["name"]), q)))
    return c.filter(F.col("profile.years_of_experience").between(3, 20) & every).select(F.col("c_custkey").alias("id"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def jn1_owned_orders(spark, sf_dir):
    c = t(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey", "c_name")
    return t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1) ON user_id = c_custkey")
def jn2_lookup_with_default(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return t(spark, sf_dir, "customer").join(e, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def jn4_semi_join(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 100").select(F.col("user_id").alias("o_custkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(e, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH o AS (SELECT DISTINCT c_nationkey AS id, lower(c_mktsegment) || o_orderpriority || (o_orderkey % 40)::VARCHAR AS skill FROM orders JOIN customer ON c_custkey = o_custkey),
 n AS (SELECT skill, count(*) AS owners FROM o GROUP BY 1)
 SELECT id, count(*) FILTER (owners = (SELECT count(DISTINCT id) FROM o)) AS shared, count(*) FILTER (owners = 1) AS "unique", (SELECT count(*) FROM n) - count(*) AS missing FROM o JOIN n USING (skill) GROUP BY 1""")
def jn14_set_comparison(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = o.select(F.col("c_nationkey").alias("id"), F.concat(F.lower("c_mktsegment"), "o_orderpriority", (F.col("o_orderkey") % 40).cast("string")).alias("skill"))
    return compare.skill_owners(named, "id", "skill")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey AS id, o_totalprice AS score FROM orders QUALIFY rank <= 200),
 b AS (SELECT row_number() OVER (ORDER BY round(o_totalprice, -3) DESC, o_orderkey)::INT AS rank, o_orderkey AS id, o_totalprice AS score FROM orders QUALIFY rank <= 190)
 SELECT coalesce(a.rank, b.rank) AS rank, coalesce(a.id, -1) AS base_id, coalesce(a.score, -1) AS base_score, coalesce(b.id, -1) AS now_id, coalesce(b.score, -1) AS now_score FROM a FULL JOIN b ON a.rank = b.rank WHERE a.id IS DISTINCT FROM b.id OR coalesce(abs(a.score - b.score) > 1e-5, TRUE)""")
def jn15_regression(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.round("o_totalprice", -3).alias("coarse"))
    a = rk.rank_top(rk.top(o, 200, [("score", True), ("id", False)]), [("score", True), ("id", False)])
    b = rk.rank_top(rk.top(o, 190, [("coarse", True), ("id", False)]), [("coarse", True), ("id", False)])
    return compare.regression(a, b).fillna(-1)


@query("SELECT p_name FROM part WHERE p_size > 25 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#2'")
def set4_difference(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.filter("p_size > 25").select("p_name").subtract(p.filter("p_brand = 'Brand#2'").select("p_name"))


@query("SELECT p_name FROM part WHERE p_size > 45 INTERSECT SELECT p_name FROM part WHERE p_brand = 'Brand#2'")
def set2_intersection(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.filter("p_size > 45").select("p_name").intersect(p.filter("p_brand = 'Brand#2'").select("p_name"))


@query("SELECT p_name FROM part WHERE p_size > 48 UNION SELECT p_name FROM part WHERE p_brand = 'Brand#2'")
def set1_union(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.filter("p_size > 48").select("p_name").union(p.filter("p_brand = 'Brand#2'").select("p_name")).distinct()


@query("SELECT round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50 FROM lineitem")
def agg6_exact_percentile(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem")
    p = lambda q, name: rk.exact_percentile(lines, "l_extendedprice", q).select(r("percentile", 4).alias(name))
    return p(0.99, "p99").crossJoin(p(0.5, "p50"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(avg(o_totalprice), 2) AS mean, count(*) AS n FROM orders GROUP BY 1")
def agg6_percentile(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    p99 = rk.grouped_percentile(orders, ["o_orderpriority"], "o_totalprice", 0.99).select("o_orderpriority", r("percentile", 4).alias("p99"))
    return p99.join(orders.groupBy("o_orderpriority").agg(r(F.avg("o_totalprice"), 2).alias("mean"), F.count("*").alias("n")), "o_orderpriority")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY 1 ORDER BY n DESC, term LIMIT 15")
def agg7_histogram(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_partkey").join(t(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return pool.term_histogram(lines, F.split("p_name", " "))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def agg21_status_counts(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), r(F.avg("value"), 4).alias("mean"))


@query("""WITH a AS (SELECT count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS m FROM lineitem WHERE l_suppkey = 1), b AS (SELECT count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS m FROM lineitem WHERE l_suppkey = 2)
 SELECT round(a.n + a.q + a.m, 2) AS a_total, round(b.n + b.q + b.m, 2) AS b_total, (a.n > b.n)::INT + (a.q > b.q)::INT + (a.m > b.m)::INT AS a_wins, (b.n > a.n)::INT + (b.q > a.q)::INT + (b.m > a.m)::INT AS b_wins,
 CASE WHEN a.n + a.q + a.m >= b.n + b.q + b.m THEN 'a' ELSE 'b' END AS winner FROM a, b""")
def agg22_head_to_head(spark, sf_dir):
    one = lambda k: t(spark, sf_dir, "lineitem").filter(f"l_suppkey = {k}").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("m"))
    out = compare.head_to_head(one(1), one(2), ["n", "q", "m"])
    return out.withColumns({"a_total": r("a_total", 2), "b_total": r("b_total", 2)})


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win4_latest(spark, sf_dir):
    return rk.latest(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [("ts", True), ("event_id", True)])


@query("""WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 400)::INT AS b, o_orderkey FROM orders),
 f AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM f),
 m AS (SELECT o_custkey, isle, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
 SELECT o_custkey, sum(date_diff('day', a, b))::BIGINT AS covered_days, count(*) AS islands FROM m GROUP BY 1""")
def win5_interval_merge(spark, sf_dir):
    s = t(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).alias("b"))
    return intervals.covered_days(s, ["o_custkey"], "a", "b")


@query("""WITH x AS (SELECT o_custkey, o_orderpriority, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
 SELECT o_custkey, count(*) FILTER (p IS NOT NULL AND p <> o_orderstatus) AS promotions, count(DISTINCT o_orderpriority) AS companies FROM x GROUP BY 1""")
def win6_promotions(spark, sf_dir):
    return intervals.promotions(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("""WITH v AS (SELECT event_id % 500 AS k, ts, event_id, event_type = 'error' AS gone, value FROM events) SELECT k, event_id, value FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id) = 1 AND NOT gone""")
def snk9_current_versions(spark, sf_dir):
    log = t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("k"), "ts", "event_id", (F.col("event_type") == "error").alias("gone"), "value")
    return writers.current_versions(log, ["k"], "ts", "gone", tie="event_id").select("k", "event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def snk10_delete(spark, sf_dir):
    gone = t(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return writers.without_keys(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey")


# --- features over derived profiles --------------------------------------------------------------------------

_IS_OFF = f"({any_hit('current_title', SPEC.offdomain_titles)} AND NOT {any_hit('current_title', SPEC.relevant_titles)})"
_FEATURES = SQL + rf""",
cov AS (
  SELECT id, sum(trust) AS covered FROM (
    SELECT f.id, f.req, least(greatest(0.25 + 0.45 * least(l.months / 24.0, 1) + 0.30 * least(l.endorsements / 12.0, 1), 0), 1)::DOUBLE AS trust
    FROM (SELECT id, req, arg_min(name, pos) AS name FROM ski, (VALUES {", ".join(f"('{x}')" for x in SPEC.req_skills)}) v(req) WHERE contains(name, req) GROUP BY 1, 2) f
    JOIN (SELECT id, name, arg_max(months, pos) AS months, arg_max(endorsements, pos) AS endorsements FROM ski GROUP BY 1, 2) l ON l.id = f.id AND l.name = f.name) GROUP BY 1
),
spe AS (SELECT id, count(DISTINCT sp) AS n FROM ski, (VALUES {", ".join(f"('{x}')" for x in SPEC.specialist)}) v(sp) WHERE contains(name, sp) GROUP BY 1),
con AS (SELECT id, count(*) FILTER (contains(lower(company), '1-urgent') OR contains(lower(company), '2-high')) AS service FROM car GROUP BY 1),
f0 AS (
  SELECT txt.id, candidate_id, current_title, location, country,
    {hits("full_text", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE AS semantic_proxy,
    least({words("current_title", SPEC.title_terms)} / 2.0::DOUBLE, 1) AS title_similarity,
    least(coalesce(covered, 0) / {len(SPEC.req_skills)}.0::DOUBLE, 1) AS skill_coverage,
    least(coalesce(spe.n, 0) / 3.0::DOUBLE, 1) AS specialist_skill_bonus,
    CASE WHEN years > 0 THEN years ELSE worked / 12.0::DOUBLE END AS years_of_experience,
    coalesce(complete, 50) / 100.0::DOUBLE + least(coalesce(code, 0) / 100.0::DOUBLE, 1) + CASE WHEN email THEN 0.5 ELSE 0 END + CASE WHEN linked THEN 0.5 ELSE 0 END AS quality_score,
    0.30 * coalesce(response, 0) + 0.20 * coalesce(least(greatest(1 - greatest(0, date_diff('day', last_active, DATE '{SPEC.reference_date}') - 30) / 150.0::DOUBLE, 0), 1), 0.5)
      + CASE WHEN open THEN 0.15 ELSE 0 END + 0.15 * (1 - 1.0::DOUBLE / (1 + exp(-0.05 * (coalesce(notice, 90) - 45)))) + 0.10 * coalesce(interview, 0) + 0.10 * least(coalesce(saved, 0) / 10.0::DOUBLE, 1) AS hireability_score,
    CASE WHEN service >= 1 AND service = spells THEN 0.0 ELSE 1.0 END::DOUBLE AS startup_readiness,
    CASE WHEN spells = 0 THEN 0.5 WHEN worked / 12.0::DOUBLE / spells < 1.5 THEN 0.0 ELSE least(worked / 12.0::DOUBLE / spells / 3.0, 1) END AS behavioral_reliability,
    CASE WHEN {any_hit("location", SPEC.preferred_cities)} THEN 1.0 WHEN contains(country, 'europe') OR {any_hit("location", SPEC.home_places)} THEN 0.85 WHEN willing THEN 0.6 ELSE 0.25 END::DOUBLE AS location_fit,
    {_IS_OFF} AS off,
    CASE WHEN {any_hit("trajectory_text", SPEC.research_markers)} AND NOT {any_hit("trajectory_text", SPEC.production_markers)} THEN 1.0 ELSE 0.0 END::DOUBLE AS research_only_penalty,
    CASE WHEN ({words("current_title", SPEC.narrow_domain)} > 0 OR {words("full_text", SPEC.narrow_domain)} > 0) AND {words("full_text", SPEC.counter_domain)} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS narrow_domain_penalty
  FROM txt LEFT JOIN cov ON cov.id = txt.id LEFT JOIN spe ON spe.id = txt.id LEFT JOIN con ON con.id = txt.id LEFT JOIN sig ON sig.id = txt.id
),
f AS (
  SELECT *, semantic_proxy AS semantic_sim, semantic_proxy * 0.8 AS bm25_score, off::INT::DOUBLE AS offdomain_title_penalty,
    CASE WHEN years_of_experience < 5 THEN greatest(0, 1 - (5 - years_of_experience) / 5) WHEN years_of_experience > 9 THEN greatest(0, 1 - (years_of_experience - 9) / 12) ELSE 1 END AS seniority_alignment,
    CASE WHEN semantic_proxy > 0.25 AND (title_similarity = 0 OR off) THEN 1.0 ELSE 0.0 END::DOUBLE AS keyword_trap_penalty FROM f0
)
"""
_NAMES = (
    "semantic_sim", "bm25_score", "title_similarity", "skill_coverage", "specialist_skill_bonus", "years_of_experience", "seniority_alignment", "quality_score", "hireability_score",
    "startup_readiness", "behavioral_reliability", "location_fit", "offdomain_title_penalty", "keyword_trap_penalty", "research_only_penalty", "narrow_domain_penalty",
)


@query(_FEATURES + "SELECT candidate_id, current_title, " + ", ".join(f"round({c} + 1e-9, 6)::DOUBLE AS {c}" for c in _NAMES) + " FROM f")
def fea_relative_features(spark, sf_dir):
    return features.relative_features(candidates(spark, sf_dir), SPEC).select("candidate_id", "current_title", *(r(F.col(c) + 1e-9).cast("double").alias(c) for c in _NAMES))


_HONEY = SQL + f""",
j AS (SELECT car.id, (year(e) - year(a)) * 12 + month(e) - month(a) AS span, months, cur AND b IS NOT NULL AS with_end, years
      FROM (SELECT *, coalesce(b, DATE '{SPEC.reference_date}') AS e FROM car) car JOIN prof ON prof.id = car.id),
h AS (SELECT id, bool_or(with_end) AS r1, bool_or(span < 0) AS r2, bool_or(years > 0 AND months > years * 12 + 18) AS r4, bool_or(abs(months - span) > 9) AS r5 FROM j GROUP BY 1),
x AS (SELECT id, count(*) FILTER (proficiency IN ('advanced', 'expert') AND months = 0) >= 3 AS r3 FROM ski GROUP BY 1),
hp AS (SELECT candidate_id, prof.id, concat_ws(',', CASE WHEN r1 THEN 'current_with_end' END, CASE WHEN r2 THEN 'end_before_start' END, CASE WHEN r3 THEN 'expert_without_use' END,
  CASE WHEN r4 THEN 'months_beyond_career' END, CASE WHEN r5 THEN 'months_unlike_dates' END) AS honeypot_reasons FROM prof LEFT JOIN h ON h.id = prof.id LEFT JOIN x ON x.id = prof.id)
"""


@query(_HONEY + "SELECT candidate_id, honeypot_reasons, CASE WHEN honeypot_reasons <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS honeypot FROM hp")
def fea20_integrity(spark, sf_dir):
    return features.integrity(candidates(spark, sf_dir), SPEC.reference_date).select("candidate_id", "honeypot_reasons", "honeypot")


_W = " + ".join(f"{w} * {c}" for c, w in specs.RELATIVE_WEIGHTS.items() if c != "retrieval_fusion")
_SCORED = _FEATURES + "," + _HONEY.removeprefix(SQL).lstrip().removeprefix(",") + f""",
sc AS (SELECT f.candidate_id, round({_W} - CASE WHEN honeypot_reasons <> '' THEN 100 ELSE 0 END, 6) AS raw_score FROM f JOIN hp ON hp.id = f.id ORDER BY raw_score DESC, f.candidate_id LIMIT 100),
nr AS (SELECT candidate_id, round((raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER () + 1e-9), 4) AS score FROM sc)
"""


@query(_SCORED + "SELECT candidate_id, score, row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS rank FROM nr")
def s1_weighted_top_100(spark, sf_dir):
    """Features, integrity and weights over the whole pool, without retrieval."""
    from sieveline.functions.numbers import weighted

    wide = features.integrity(features.relative_features(candidates(spark, sf_dir), SPEC), SPEC.reference_date)
    weights = {k: v for k, v in specs.RELATIVE_WEIGHTS.items() if k != "retrieval_fusion"}
    scored = wide.withColumn("raw_score", r(weighted(weights) - 100.0 * F.col("honeypot"), 6)).select("candidate_id", "raw_score")
    best = rk.with_min_max(rk.top(scored, 100, [("raw_score", True), ("candidate_id", False)]), "raw_score", "u", few=True).select("candidate_id", r("u", 4).alias("score"))
    return rk.rank_top(best, [("score", True), ("candidate_id", False)])


@query()
def s1_relative_ranking(spark, sf_dir):
    """The whole relative ranking with retrieval and reasons."""
    vectors = t(spark, sf_dir, "embeddings").select(F.format_string("CAND_%07d", "vec_id").alias("id"), "embedding")
    out = rankings.relative_ranking(candidates(spark, sf_dir), vectors, query_vector(spark, sf_dir), QUERY, SPEC)
    return out.select("candidate_id", "rank", "score", "reasoning")


_LEX_OF_PROFILES = _LEX.replace(
    "docs AS (SELECT doc_id AS id, FALSE AS q, coalesce(text, '') AS text FROM documents",
    "docs AS (SELECT candidate_id AS id, FALSE AS q, concat_ws(' ', headline, summary, own_title, skills_text, career_text) AS text FROM txt",
)
_DENSE_OF_PROFILES = _DENSE.replace("vec_id AS id", "printf('CAND_%07d', vec_id) AS id")
_W_ALL = " + ".join(f"{w} * {c}" for c, w in specs.RELATIVE_WEIGHTS.items())


@query(
    _FEATURES + "," + _HONEY.removeprefix(SQL).lstrip().removeprefix(",") + f""", {_LEX_OF_PROFILES}, {_DENSE_OF_PROFILES}, {_RRF},
fu AS (SELECT id, cosine, least(greatest(lexical / ((SELECT quantile_cont(lexical, 0.99) FROM lex) + 1e-9), 0), 1) AS share,
  (rrf - (SELECT min(rrf) FROM fused)) / ((SELECT max(rrf) - min(rrf) FROM fused) + 1e-9) AS retrieval_fusion FROM fused),
w0 AS (SELECT f.* EXCLUDE (semantic_sim, bm25_score), least(greatest(cosine, 0), 1) AS semantic_sim, share AS bm25_score, retrieval_fusion, honeypot_reasons FROM f JOIN fu ON fu.id = f.candidate_id JOIN hp ON hp.id = f.id),
s0 AS (SELECT candidate_id, round({_W_ALL} - CASE WHEN honeypot_reasons <> '' THEN 100 ELSE 0 END, 8) AS raw_score FROM w0 ORDER BY raw_score DESC, candidate_id LIMIT 100),
s1 AS (SELECT candidate_id, round((raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER () + 1e-9), 4) AS score FROM s0)
SELECT candidate_id, score, row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS rank FROM s1"""
)
def s1_relative_scores(spark, sf_dir):
    """The whole relative ranking with retrieval: who is where."""
    return s1_relative_ranking(spark, sf_dir).select("candidate_id", "score", "rank")


def _best(column: str, fams: dict) -> str:
    hit = {k: words(column, v) for k, v in fams.items()}
    most = "greatest(" + ", ".join(hit.values()) + ")"
    return f"CASE WHEN {most} = 0 THEN 'Unknown' " + " ".join(f"WHEN {h} = {most} THEN '{k}'" for k, h in hit.items()) + " END"


_FAM = SQL + rf""",
g0 AS (SELECT txt.id, candidate_id, first_title, skills_text, description_text,
  least({words("first_title", SPEC.title_terms)} / 2.0::DOUBLE, 1) AS title_affinity, {words("skills_text", SPEC.req_skills)} / {len(SPEC.req_skills)}.0::DOUBLE AS skill_affinity,
  {words("description_text", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE AS career_affinity, {words("(skills_text || ' ' || description_text)", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE AS semantic_sim,
  {_best("first_title", ROLES)} AS title_family, {_best("skills_text", SKILLS)} AS skill_family, {_best("description_text", SKILLS)} AS career_family,
  coalesce(complete, 50) / 100.0::DOUBLE + least(coalesce(code, 0) / 100.0::DOUBLE, 1) + CASE WHEN email THEN 0.5 ELSE 0 END + CASE WHEN linked THEN 0.5 ELSE 0 END AS quality_score
  FROM txt LEFT JOIN sig ON sig.id = txt.id),
g AS (SELECT *, title_family = 'Building' AND skill_family = 'Building' AND career_family = 'Building' AS is_consistent,
  title_family NOT IN ('Building', 'Unknown') AND skill_family NOT IN ('Building', 'Unknown') AND career_family NOT IN ('Building', 'Unknown') AS is_inconsistent FROM g0)
"""


@query(_FAM + """SELECT candidate_id, title_family, skill_family, career_family, is_consistent, is_inconsistent, NOT is_consistent AND NOT is_inconsistent AS is_partial, round(final_score, 6) AS final_score,
 row_number() OVER (ORDER BY round(final_score, 6) DESC, candidate_id)::INT AS rank FROM (SELECT *, 2.5 * title_affinity + 3.5 * skill_affinity + 2.5 * career_affinity + semantic_sim + 0.8 * semantic_sim + quality_score
 - CASE WHEN is_consistent THEN 0 ELSE 2 END AS final_score FROM g) QUALIFY rank <= 100""")
def s2_frozen_family_ranking(spark, sf_dir):
    out = rankings.frozen_ranking(candidates(spark, sf_dir), SPEC, ROLES, SKILLS)
    return out.select("candidate_id", "title_family", "skill_family", "career_family", "is_consistent", "is_inconsistent", "is_partial", "final_score", "rank")


@query(_FAM + "SELECT round(avg(is_consistent::INT) * 100, 4) AS consistent, round(avg(is_inconsistent::INT) * 100, 4) AS inconsistent, round(avg((NOT is_consistent AND NOT is_inconsistent)::INT) * 100, 4) AS partial FROM g")
def agg17_consistency_shares(spark, sf_dir):
    texts = features.with_texts(candidates(spark, sf_dir)).withColumn("current_title", F.lower(F.coalesce(F.get("__career", F.lit(0))["title"], F.lit(""))))
    fam = families.family_features(texts, SPEC, ROLES, SKILLS)
    return fam.agg(*(r(F.avg(F.col(c).cast("int")) * 100, 4).alias(n) for c, n in (("is_consistent", "consistent"), ("is_inconsistent", "inconsistent"), ("is_partial", "partial"))))


@query(_FAM + f""", z AS (SELECT *, {any_hit("first_title", specs.TRAP_TITLES)} AND NOT contains(first_title, 'engineer') AS trap, round(2.5 * title_affinity + 3.5 * skill_affinity + 2.5 * career_affinity + semantic_sim + 0.8 * semantic_sim + quality_score
 - CASE WHEN is_consistent THEN 0 ELSE 2 END, 6) AS final_score FROM g ORDER BY final_score DESC, candidate_id LIMIT 100)
 SELECT round(avg(trap::INT) * 100, 4) AS trap, round(avg(is_consistent::INT) * 100, 4) AS consistent, round(avg((NOT is_consistent AND NOT is_inconsistent)::INT) * 100, 4) AS partial, round(avg(is_inconsistent::INT) * 100, 4) AS inconsistent FROM z""")
def agg17_top_100_quality(spark, sf_dir):
    """Traps and consistency among the best hundred of the frozen ranking."""
    return families.quality_shares(rankings.frozen_ranking(candidates(spark, sf_dir), SPEC, ROLES, SKILLS))


@query(SQL + rf""", q AS (SELECT txt.id, candidate_id, least({words("current_title", SPEC.title_terms)} / 2.0::DOUBLE, 1) AS t, {words("skills_text", SPEC.req_skills)} / {len(SPEC.req_skills)}.0::DOUBLE AS s,
  {words("description_text", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE AS c, {_best("current_title", ROLES)} AS tf,
  CASE WHEN {words("skills_text", SKILLS["Building"])} >= 2 THEN 'Building' ELSE {_best("skills_text", SKILLS)} END AS sf, {_best("description_text", ROLES)} AS cf,
  coalesce(complete, 50) / 100.0::DOUBLE + least(coalesce(code, 0) / 100.0::DOUBLE, 1) + CASE WHEN email THEN 0.5 ELSE 0 END + CASE WHEN linked THEN 0.5 ELSE 0 END AS quality
  FROM txt LEFT JOIN sig ON sig.id = txt.id),
 z AS (SELECT candidate_id, round(greatest((2.5 * t + 3.5 * s + 2.5 * c + quality) * CASE WHEN tf = 'Building' AND sf = 'Building' AND cf = 'Building' THEN 1 ELSE 0.8 END / 11.5 * 100, 0), 6)::DOUBLE AS final_score FROM q)
 SELECT candidate_id, final_score, row_number() OVER (ORDER BY final_score DESC, candidate_id)::INT AS rank FROM z QUALIFY rank <= 100""")
def s3_scaled_family_ranking(spark, sf_dir):
    return rankings.scaled_ranking(candidates(spark, sf_dir), SPEC, ROLES, SKILLS).select("candidate_id", "final_score", "rank")


_ANTI = {"small": 1.0, "1-urgent": 0.8, "blue": 0.6}
_POOL = SQL + rf""",
ant AS (SELECT car.id, sum(w * least(greatest(months, 6) / 24.0::DOUBLE, 1)) AS p FROM car JOIN txt ON txt.id = car.id, (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _ANTI.items())}) v(term, w)
  WHERE contains(lower(title), term) OR contains(lower(description), term) OR contains(skills_text, term) GROUP BY 1),
con AS (SELECT id, count(*) FILTER (contains(lower(company), '1-urgent') OR contains(lower(company), '2-high')) AS service FROM car GROUP BY 1),
p AS (SELECT txt.id, candidate_id, {hits("(skills_text || ' ' || coalesce((SELECT lower(description) FROM car WHERE car.id = txt.id AND pos = 1), ''))", SPEC.keywords)} / {len(SPEC.keywords)}.0::DOUBLE AS semantic_sim,
  least({hits("first_title", SPEC.title_terms)} / 2.0::DOUBLE, 1) AS title_similarity, {hits("skills_text", SPEC.req_skills)} / {len(SPEC.req_skills)}.0::DOUBLE AS skill_coverage,
  greatest(0, 1 - abs(worked / 12.0::DOUBLE - 5) / 10) AS seniority_alignment, least(coalesce(ant.p, 0), 1) AS anti_skill_penalty,
  coalesce(complete, 50) / 100.0::DOUBLE + least(coalesce(code, 0) / 100.0::DOUBLE, 1) + CASE WHEN email THEN 0.5 ELSE 0 END + CASE WHEN linked THEN 0.5 ELSE 0 END AS quality_score,
  0.5 * coalesce(response, 0) + CASE WHEN open THEN 0.2 ELSE 0 END + 0.3 * (1 - 1.0::DOUBLE / (1 + exp(-0.1 * (coalesce(notice, 90) - 30)))) AS hireability_score,
  CASE WHEN service >= 1 AND service = spells THEN 0.0 ELSE 1.0 END::DOUBLE AS startup_readiness_score,
  CASE WHEN spells = 0 THEN 0.5 WHEN worked / 12.0::DOUBLE / spells < 1.5 THEN 0.0 ELSE least(worked / 12.0::DOUBLE / spells / 3.0, 1) END AS behavioral_reliability_score
  FROM txt LEFT JOIN ant ON ant.id = txt.id LEFT JOIN con ON con.id = txt.id LEFT JOIN sig ON sig.id = txt.id),
ps AS (SELECT *, CASE WHEN semantic_sim > 0.6 AND title_similarity = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS keyword_stuffing_risk FROM p),
pp AS (SELECT *, round(4.95 * title_similarity + 2.18 * semantic_sim + 1.23 * skill_coverage + 0.88 * seniority_alignment + 0.81 * quality_score + 0.62 * semantic_sim - 7.31 * keyword_stuffing_risk
  + 0.5 * (hireability_score + startup_readiness_score + behavioral_reliability_score), 6) AS pool_score FROM ps)
"""


def _pool(spark, sf_dir):
    return pool.pool_features(candidates(spark, sf_dir), SPEC, anti=_ANTI)


@query(_POOL + "SELECT candidate_id, " + ", ".join(f"round({'semantic_sim' if c == 'bm25_score' else c}, 6)::DOUBLE AS {c}" for c in pool.MODEL_COLUMNS) + " FROM ps")
def p_pool_features(spark, sf_dir):
    return _pool(spark, sf_dir).select("candidate_id", *(r(c).cast("double").alias(c) for c in pool.MODEL_COLUMNS))


@query(_POOL + """, b AS (SELECT * FROM pp ORDER BY pool_score DESC, candidate_id LIMIT 100)
 SELECT candidate_id, round(CASE WHEN max(pool_score) OVER () = min(pool_score) OVER () THEN 0.5 ELSE (pool_score - min(pool_score) OVER ()) / (max(pool_score) OVER () - min(pool_score) OVER ()) END * 100, 2) AS final_score,
 row_number() OVER (ORDER BY pool_score DESC, candidate_id)::INT AS rank FROM b""")
def s4_pool_ranking(spark, sf_dir):
    scored = pool.linear_score(_pool(spark, sf_dir)).withColumn("pool_score", r("pool_score")).select("candidate_id", "pool_score")
    return pool.packed(scored).select("candidate_id", "final_score", "rank")


@query(_POOL + "SELECT count(*) FILTER (keyword_stuffing_risk > 0) AS keyword_traps, count(*) FILTER (round(anti_skill_penalty, 9) > 0.3) AS foreign_skills, count(*) FILTER (skill_coverage < 0.25) AS few_skills, count(*) FILTER (round(seniority_alignment, 9) < 0.5) AS seniority_off FROM ps")
def agg9_rejections(spark, sf_dir):
    return pool.rejection_counts(_pool(spark, sf_dir).withColumns({"anti_skill_penalty": r("anti_skill_penalty", 9), "seniority_alignment": r("seniority_alignment", 9)}))


@query(_POOL + """, b AS (SELECT *, row_number() OVER (ORDER BY pool_score DESC, candidate_id) AS rank FROM pp QUALIFY rank <= 100),
 u AS (SELECT rank, 'hireability_score' AS signal, hireability_score AS v FROM b UNION ALL SELECT rank, 'startup_readiness_score', startup_readiness_score FROM b UNION ALL SELECT rank, 'behavioral_reliability_score', behavioral_reliability_score FROM b)
 SELECT signal, count(*) AS n, round(avg(rank), 1) AS mean_rank, round(avg(round(v, 9)) * 100, 1) AS mean_percent FROM u WHERE round(v, 9) > 0.3 GROUP BY 1 ORDER BY n DESC, signal LIMIT 6""")
def agg8_signal_statistics(spark, sf_dir):
    names = ("hireability_score", "startup_readiness_score", "behavioral_reliability_score")
    scored = pool.linear_score(_pool(spark, sf_dir)).withColumn("pool_score", r("pool_score"))
    ranked = rk.rank_top(rk.top(scored.select("candidate_id", "pool_score", *(r(c, 9).alias(c) for c in names)), 100, [("pool_score", True), ("candidate_id", False)]), [("pool_score", True), ("candidate_id", False)])
    return pool.signal_statistics(ranked, names)


@query(_POOL + """, b AS (SELECT * FROM pp ORDER BY pool_score DESC, candidate_id LIMIT 100), n AS (SELECT round((pool_score - min(pool_score) OVER ()) / (max(pool_score) OVER () - min(pool_score) OVER ()) * 100, 2) AS s FROM b)
 SELECT (SELECT count(*) FROM pp) AS total, (SELECT count(*) FROM pp WHERE title_similarity > 0) AS retrieved, count(*) AS ranked, count(*) FILTER (s >= 30) AS shortlisted FROM n""")
def agg11_funnel(spark, sf_dir):
    wide = _pool(spark, sf_dir).select("candidate_id", "title_similarity", *(c for c in specs.POOL_WEIGHTS if c != "title_similarity"))
    scored = pool.linear_score(wide).withColumn("pool_score", r("pool_score"))
    return pool.funnel(wide, wide.filter("title_similarity > 0"), pool.packed(scored.select("candidate_id", "pool_score")))


@query(SQL + rf""", m AS (SELECT id, count(DISTINCT w) AS n FROM ski, (VALUES {", ".join(f"('{x}')" for x in specs.SHOWCASE_SKILLS)}) v(w) WHERE contains(name, w) OR contains(w, name) GROUP BY 1),
 s AS (SELECT candidate_id, round(3 * coalesce(n, 0) + 2 * {hits("(headline || ' ' || summary || ' ' || current_title)", specs.SHOWCASE_PROFILE)} + {hits("career_text", specs.SHOWCASE_CAREER)} + 4 * coalesce(best, 0) / 100.0::DOUBLE, 6) AS relevance
 FROM txt LEFT JOIN m ON m.id = txt.id LEFT JOIN sig ON sig.id = txt.id)
 SELECT candidate_id, relevance, row_number() OVER (ORDER BY relevance DESC, candidate_id)::INT AS rank FROM s QUALIFY rank <= 40""")
def s5_showcase_ranking(spark, sf_dir):
    return rankings.showcase_ranking(candidates(spark, sf_dir)).select("candidate_id", "relevance", "rank")


@query(SQL + rf"""SELECT candidate_id, concat_ws(',', {", ".join(f"CASE WHEN {words('skills_text', (x,))} > 0 THEN '{x}' END" for x in SPEC.req_skills)}) AS matched,
 {len(SPEC.req_skills)} - {words("skills_text", SPEC.req_skills)} AS n_missing FROM txt""")
def fam8_matched_and_missing(spark, sf_dir):
    found, missing = families.matched_and_missing(F.col("skills_text"), SPEC.req_skills)
    return features.with_texts(candidates(spark, sf_dir)).select("candidate_id", F.array_join(found, ",").alias("matched"), F.size(missing).alias("n_missing"))


# --- taxonomy, extraction, quality of rankings ---------------------------------------------------------------

def _taxonomy(spark):
    rows = [("Ring", ["small ring", "blue ring", "rings"], "round", 0), ("Gear", ["hot gear", "gearbox"], "round", 1), ("Old Plate", ["plate old"], "flat", 2), ("Anvil", ["red anvil"], "heavy", 3)]
    return spark.createDataFrame(rows, "canonical string, aliases array<string>, category string, pos int")


@query()
def tax1_normalise(spark, sf_dir):
    names = t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return taxonomy.normalise_names(names, taxonomy.aliases(_taxonomy(spark))).select("p_partkey", "name", "canonical", "method")


@query("""WITH m AS (SELECT l_suppkey, p_name, p_type, l_linenumber, l_orderkey, l_returnflag = 'R' AS neg,
 CASE WHEN l_returnflag = 'R' THEN 0 WHEN p_brand = 'Brand#2' THEN 0.3 ELSE CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.5 ELSE 0.2 END END::DOUBLE AS c,
 CASE l_linenumber % 5 WHEN 0 THEN 'certification' WHEN 1 THEN 'experience' WHEN 2 THEN 'projects' WHEN 3 THEN 'education' ELSE 'skills' END AS s FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT l_suppkey, lower(p_type) AS canonical, count(*) AS mentions, count(*) FILTER (neg) AS negated_mentions, string_agg(DISTINCT s, ',' ORDER BY s) AS sections, round(1 - product(1 - c), 2) AS confidence, count(*) FILTER (neg) < count(*) AS eligible FROM m GROUP BY 1, 2""")
def tax3_merge_mentions(spark, sf_dir):
    m = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    where = F.element_at(F.array(*map(F.lit, ("Certifications", "employment", "project", "academic", "other"))), F.col("l_linenumber") % 5 + 1)
    m = m.select("l_suppkey", F.col("p_type").alias("canonical"), F.col("p_name").alias("name"), where.alias("source_section"), F.when(F.col("p_brand") == "Brand#2", "Familiar with it").alias("context"),
                 (F.col("l_returnflag") == "R").alias("negated"), F.col("l_orderkey").alias("pos"))
    return taxonomy.merge_mentions(m, ["l_suppkey"]).drop("name")


@query(r"""SELECT doc_id, regexp_extract(text, '([A-Za-z0-9_.+\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,})', 1) AS email, trim(regexp_extract(text, '([+(]?[0-9][0-9\t\n\x0b\f\r \-().]{8,}[0-9])', 1)) AS phone,
 CASE WHEN contains(lower(text), 'senior') THEN 'senior' WHEN contains(lower(text), 'junior') THEN 'junior' WHEN contains(lower(text), 'lead') OR contains(lower(text), 'manager') THEN 'lead' ELSE 'mid' END AS seniority FROM documents""")
def res1_contacts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", ex.email(F.col("text")).alias("email"), ex.phone(F.col("text")).alias("phone"), ex.seniority(F.col("text")).alias("seniority"))


@query(r"""SELECT event_id, round(greatest(0.55, 1 - 0.35 * least(greatest(round(0.4 * (value / 100) + 0.6 * (user_id / 150.0), 2), 0), 1)), 2)::DOUBLE AS confidence, round(0.4 * (value / 100) + 0.6 * (user_id / 150.0), 2)::DOUBLE > 0.6 AS warned FROM events WHERE event_id % 2 >= 0""")
def res18_confidence(spark, sf_dir):
    c = ex.layout_complexity(F.col("value") / 100, F.col("user_id") / 150.0)
    return t(spark, sf_dir, "events").select("event_id", ex.extraction_confidence(c).alias("confidence"), (F.size(ex.layout_warnings(c)) > 0).alias("warned"))


_HEADS = ", ".join(f"('{h}', '{name}')" for name, hs in ex.SECTIONS.items() for h in hs)


@query(rf"""WITH hs(h, name) AS (VALUES {_HEADS}), l0 AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
 l AS (SELECT id, pos, trim(raw) AS line FROM l0 WHERE trim(raw) <> ''),
 b AS (SELECT *, trim(regexp_replace(lower(line), '[:—]+$', '')) AS bare, regexp_extract(lower(line), '^([a-z ]+?)(:| —)', 1) AS head FROM l),
 n AS (SELECT b.*, x.name AS whole, coalesce(x.name, y.name) AS heading FROM b LEFT JOIN hs x ON x.h = bare LEFT JOIN hs y ON y.h = head),
 o AS (SELECT id, pos, heading, CASE WHEN whole IS NOT NULL THEN '' WHEN heading IS NOT NULL THEN trim(regexp_replace(line, '^[^:—]*[:—]\s*[-—]?', '')) ELSE line END AS line FROM n),
 s AS (SELECT id, pos, line, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Summary') AS section FROM o)
 SELECT id, pos::INT AS pos, section, line FROM s WHERE line <> ''""")
def res4_sections(spark, sf_dir):
    return ex.sections(t(spark, sf_dir, "documents"), "doc_id", "text")


@query(SQL + f""", e AS (SELECT car.id, a, coalesce(b, DATE '{SPEC.reference_date}') AS z, title, company, industry, pos FROM car),
 k AS (SELECT id, count(*) AS n, greatest(0.5, date_diff('day', min(a), max(z)) / 365.25::DOUBLE) AS years, avg(greatest(0.08, date_diff('day', a, z) / 365.25::DOUBLE)) AS tenure, count(DISTINCT lower(industry)) AS kinds, count(DISTINCT lower(company)) AS firms FROM e GROUP BY 1),
 u AS (SELECT id, count(*) FILTER (p IS NOT NULL AND lower(p) <> lower(title)) AS ups FROM (SELECT *, lag(title) OVER (PARTITION BY id, lower(company) ORDER BY strftime(a, '%Y-%m-%d'), pos) AS p FROM car) GROUP BY 1),
 m AS (SELECT candidate_id, coalesce(n, 0) AS n, tenure, coalesce(ups, 0) / k.years AS rate, least(1.0, CASE WHEN kinds > 0 THEN kinds ELSE firms END / n::DOUBLE) AS spread, firms FROM prof LEFT JOIN k ON k.id = prof.id LEFT JOIN u ON u.id = prof.id),
 t AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN rate >= 0.45 OR (rate >= 0.30 AND tenure >= 1.2) THEN 'fast_climber' WHEN tenure BETWEEN 3.0 AND 5.5 AND spread <= 0.65 THEN 'stable_performer' WHEN tenure < 2.0 AND spread >= 0.7 AND firms >= 3 THEN 'chaotic_hopper' ELSE 'mixed' END AS archetype FROM m)
 SELECT candidate_id, archetype, round(CASE archetype WHEN 'unknown' THEN 0.5 WHEN 'fast_climber' THEN least(1.0, 0.7 + rate / 2) WHEN 'stable_performer' THEN 0.9 WHEN 'chaotic_hopper' THEN 0.4 ELSE 0.6 END, 4)::DOUBLE AS trajectory_score FROM t""")
def trj1_trajectories(spark, sf_dir):
    c = candidates(spark, sf_dir)
    ups = intervals.promotions(
        c.select("candidate_id", F.posexplode("career_history").alias("pos", "j")).select("candidate_id", "pos", F.col("j.company").alias("company"), F.col("j.title").alias("title"), F.col("j.start_date").alias("a")),
        ["candidate_id"], "company", "title", "a", "pos",
    )
    joined = c.join(ups.select("candidate_id", "promotions"), "candidate_id", "left").withColumn("promotions", F.coalesce("promotions", F.lit(0)))
    jobs = F.coalesce("career_history", F.array().cast(c.schema["career_history"].dataType))
    out = intervals.trajectory(joined.withColumn("jobs", jobs), "jobs", "promotions", F.lit(SPEC.reference_date).cast("date"))
    return out.select("candidate_id", "archetype", r("trajectory_score", 4).alias("trajectory_score"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, printf('CAND_%07d', o_orderkey % 95) AS candidate_id, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) % 30 = 0 THEN 9.0 ELSE 1000000 - o_totalprice * 0 END::DOUBLE AS score FROM orders QUALIFY rank <= 100),
 n AS (SELECT *, lead(score) OVER (ORDER BY rank, candidate_id) AS ns, lead(candidate_id) OVER (ORDER BY rank, candidate_id) AS ni FROM b),
 u AS (SELECT 'repeated_id' AS problem, count(candidate_id) - count(DISTINCT candidate_id) AS n FROM n UNION ALL SELECT 'score_rises', count(*) FILTER (ns > score) FROM n UNION ALL SELECT 'tie_order', count(*) FILTER (ns = score AND ni < candidate_id) FROM n)
 SELECT * FROM u WHERE n > 0""")
def val1_submission_problems(spark, sf_dir):
    ranked = rk.rank_top(rk.top(t(spark, sf_dir, "orders"), 100, [("o_totalprice", True), ("o_orderkey", False)]), [("o_totalprice", True), ("o_orderkey", False)])
    sub = ranked.select(F.format_string("CAND_%07d", F.col("o_orderkey") % 95).alias("candidate_id"), F.col("rank").cast("string").alias("rank"), F.when(F.col("rank") % 30 == 0, "9.0").otherwise("1000000.0").alias("score"), F.lit("x").alias("reasoning"))
    return validate.ranking_problems(sub)


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY doc_id)::INT AS rank, quality AS rel FROM labels), c AS (SELECT *, sum(rel) OVER (ORDER BY rank) AS seen FROM b),
 i AS (SELECT sum(1 / log2(k + 1)) FILTER (k <= 10) AS i10, sum(1 / log2(k + 1)) AS i50 FROM range(1, 51) t(k) WHERE k <= (SELECT sum(rel) FROM b))
 SELECT round(sum(rel / log2(rank + 1)) FILTER (rank <= 10) / any_value(i10), 6) AS ndcg10, round(sum(rel / log2(rank + 1)) FILTER (rank <= 50) / any_value(i50), 6) AS ndcg50,
 round(sum(CASE WHEN rel > 0 THEN seen / rank ELSE 0 END)::DOUBLE / sum(rel), 6) AS average_precision, round(sum(rel) FILTER (rank <= 5) / 5.0, 6)::DOUBLE AS p5 FROM c, i""")
def ir_metrics(spark, sf_dir):
    ranked = rk.global_rank(t(spark, sf_dir, "labels"), [("doc_id", False)]).select((F.col("rank") + 1).alias("rank"), F.col("quality").alias("relevance"))
    return validate.composite_quality(ranked).select(*(r(c).alias(c) for c in ("ndcg10", "ndcg50", "average_precision", "p5")))


@query(SQL + """SELECT candidate_id, spells, worked::BIGINT AS months, round(worked / 12.0::DOUBLE, 6) AS years, (SELECT count(*) FROM car WHERE car.id = txt.id AND contains(lower(company), '1-urgent')) AS urgent,
 length(skills_text) AS skill_chars, length(trajectory_text) AS text_chars, current_title FROM txt""")
def prj_texts_and_tenure(spark, sf_dir):
    """Flattened texts, title fallback, tenure and conditional counts."""
    c = features.with_texts(candidates(spark, sf_dir))
    urgent = F.size(F.filter("__career", lambda j: F.contains(tx.low(j["company"]), F.lit("1-urgent"))))
    months = features.months_worked()
    return c.select("candidate_id", F.size("__career").cast("long").alias("spells"), months.cast("long").alias("months"), r(months / 12.0).alias("years"), urgent.cast("long").alias("urgent"),
                    F.length("skills_text").cast("long").alias("skill_chars"), F.length("trajectory_text").cast("long").alias("text_chars"), "current_title")


@query(SQL + "SELECT candidate_id, pos, round(least(greatest(0.25 + 0.45 * least(months / 24.0::DOUBLE, 1) + 0.30 * least(endorsements / 12.0::DOUBLE, 1), 0), 1) + 1e-9, 6) AS trust FROM ski JOIN prof ON prof.id = ski.id")
def fea5_skill_trust(spark, sf_dir):
    c = features.with_texts(candidates(spark, sf_dir)).select("candidate_id", F.posexplode("__skills").alias("p", "s"))
    return c.select("candidate_id", (F.col("p") + 1).alias("pos"), r(features.skill_trust(F.col("s")) + 1e-9).alias("trust"))


@query(SQL + """SELECT candidate_id, pos, (year(coalesce(b, DATE '2024-03-15')) - year(a)) * 12 + month(coalesce(b, DATE '2024-03-15')) - month(a) AS span FROM car JOIN prof ON prof.id = car.id""")
def scl2_whole_months(spark, sf_dir):
    from sieveline.functions.dates import day, whole_months

    c = candidates(spark, sf_dir).select("candidate_id", F.posexplode("career_history").alias("p", "j"))
    end = F.coalesce(day(F.col("j.end_date")), F.lit(SPEC.reference_date).cast("date"))
    return c.select("candidate_id", (F.col("p") + 1).cast("long").alias("pos"), whole_months(day(F.col("j.start_date")), end).cast("long").alias("span"))


@query("SELECT l_orderkey, round(1 - product(1 - l_discount) + 1e-9, 4) AS hint FROM lineitem GROUP BY 1")
def agg12_noisy_or(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(taxonomy.noisy_or(F.col("l_discount") + 0.0, 4).alias("hint"))


@query("SELECT l_suppkey, arg_max(l_partkey, l_extendedprice * 1e6 + l_orderkey % 1000) AS dearest, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def agg13_representative(spark, sf_dir):
    key = F.col("l_extendedprice") * 1e6 + F.col("l_orderkey") % 1000
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_partkey", key).alias("dearest"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 80 ELSE 60 END AS trajectory_match, CASE WHEN o_orderpriority = '1-URGENT' THEN 100 WHEN contains(lower(o_orderpriority), 'u') THEN 80 ELSE 40 END AS title_match,
 (CASE WHEN o_custkey % 9 >= 5 THEN least(100, 80 + 5 * (o_custkey % 9 - 5)) ELSE 100 * (o_custkey % 9) // 5 END)::INT AS experience_match, least(100, 50 + 15 * (o_orderkey % 5))::INT AS adjacency_match FROM orders""")
def mat1_match_dimensions(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "fast_climber").when(F.col("o_orderstatus") == "O", "stable_performer").otherwise("mixed")
    low = F.lower("o_orderpriority")
    c = {
        "required": F.array(F.lit("a")), "skills": F.array(F.lit("a")), "title": low, "wanted_title": F.when(low == "1-urgent", low).otherwise("u"), "years": (F.col("o_custkey") % 9).cast("double"), "wanted_years": F.lit(5.0),
        "domain": F.lit(""), "wanted_domain": F.lit(""), "archetype": kind, "has_education": F.lit(True), "wants_education": F.lit(True), "has_certification": F.lit(True), "wants_certification": F.lit(True),
        "has_projects": F.lit(True), "is_current": F.lit(True), "transferable": F.col("o_orderkey") % 5,
    }
    got = compare.match_dimensions(c)
    return t(spark, sf_dir, "orders").select("o_orderkey", *(got[k].cast("int").alias(k) for k in ("trajectory_match", "title_match", "experience_match", "adjacency_match")))


@query("""WITH d AS (SELECT doc_id, lower(text) AS x, text FROM documents WHERE text IS NOT NULL), k AS (SELECT unnest(['the', 'licensed under', 'rights reserved', 'que']) AS skill)
 SELECT doc_id AS id, skill, trim(replace(substring(text, greatest(1, instr(x, skill) - 40), instr(x, skill) + length(skill) + 100 - greatest(1, instr(x, skill) - 40)), chr(10), ' ')) AS evidence, 0.95::DOUBLE AS confidence FROM d, k WHERE contains(x, skill)""")
def res5_skills_with_evidence(spark, sf_dir):
    return ex.compound_skills(t(spark, sf_dir, "documents"), "doc_id", "text", ("the", "licensed under", "rights reserved", "que"))


@query("""SELECT event_id, CASE WHEN regexp_matches(event_type, '^(view|click)$') THEN 'skills' ELSE 'other' END AS section, strftime(ts, '%Y') AS y, CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'view' THEN 0.3 WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'signup' THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence FROM events""")
def tax2_confidence(spark, sf_dir):
    kind = F.col("event_type")
    source = F.when(kind == "click", " Certifications ").when(kind == "signup", "EMPLOYMENT").otherwise(F.lit(None).cast("string"))
    c = taxonomy.confidence(source, F.when(kind == "view", "Basic knowledge of it"), kind == "error")
    section = F.when(kind.rlike("^(view|click)$"), "skills").otherwise("other")
    return t(spark, sf_dir, "events").select("event_id", section.alias("section"), F.date_format("ts", "yyyy").alias("y"), c.alias("confidence"))


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, ((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 4)::INT AS opener FROM orders QUALIFY rank <= 40""")
def win8_rotating_opener(spark, sf_dir):
    best = rk.rank_top(rk.top(t(spark, sf_dir, "orders"), 40, [("o_totalprice", True), ("o_orderkey", False)]), [("o_totalprice", True), ("o_orderkey", False)])
    return best.select("rank", F.pmod(F.col("rank") - 1, F.lit(4)).cast("int").alias("opener"))


@query("SELECT event_type AS kind, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def str_daily_windows(spark, sf_dir):
    """The batch form of the streaming extension's windows."""
    w = arrivals.windowed_counts(t(spark, sf_dir, "events"), "ts", "event_type", "1 day", value="value")
    return w.select(F.col("event_type").alias("kind"), F.col("start").alias("day"), "n", "total")


@query(SQL + """, s AS (SELECT candidate_id, CASE WHEN own_title <> '' THEN 'ready' WHEN spells = 0 THEN 'failed' ELSE 'processing' END AS status FROM txt) SELECT status, count(*) AS n FROM s GROUP BY 1""")
def flt19_profile_status(spark, sf_dir):
    c = candidates(spark, sf_dir)
    n = F.coalesce(F.size("career_history"), F.lit(0))
    status = F.when(F.col("profile.current_title") != "", "ready").when(n <= 0, "failed").otherwise("processing")
    return c.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over documents and vectors, the best hundred."""
    return ret3_hybrid_rrf(spark, sf_dir)


from sieveline.plans import parsed, patterns, scaled  # noqa: E402, F401  register their queries

__all__ = ["ORACLES", "QUERIES", "clip", "entry"]
