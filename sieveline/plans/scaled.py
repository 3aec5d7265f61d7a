"""Registered queries of indexes, name joins, automata, models and hot keys."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import intervals, names, parsing, pool, postings, tree_model, validate, vector_index
from sieveline.operators import ranking as rk
from sieveline.plans import queries as base
from sieveline.plans import rankings
from sieveline.plans.candidates import SPEC, candidates
from sieveline.plans.registry import query, r, t
from sieveline.streaming import statuses

_STOP = ", ".join(f"'{w}'" for w in tx.english_stop_words())
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"


# --- retrieval through indexes -----------------------------------------------------------------------------

@query(rf"""WITH tf AS (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
st AS (SELECT term, sum(n) AS ctf, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
pool AS (
  SELECT i.item_id, st.term, ctf + coalesce(q.n, 0) AS ctf, df + CASE WHEN q.n IS NULL THEN 0 ELSE 1 END AS df, q.n AS asked
  FROM (SELECT DISTINCT item_id FROM benchmark) i CROSS JOIN st LEFT JOIN q ON q.item_id = i.item_id AND q.term = st.term
  UNION ALL SELECT item_id, term, n, 1, n FROM q WHERE term NOT IN (SELECT term FROM st)
),
voc AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ctf DESC, term) <= 5000),
w AS (SELECT item_id, term, ln((2.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf, asked FROM voc),
qn AS (SELECT item_id, sqrt(sum(asked * idf * asked * idf)) AS qn FROM w WHERE asked IS NOT NULL GROUP BY 1),
s AS (SELECT w.item_id, tf.id, sum(n * idf * n * idf) AS sq, sum(n * idf * coalesce(asked, 0) * idf) AS dot FROM tf JOIN w USING (term) GROUP BY 1, 2),
sc AS (SELECT item_id, id, round(dot / (sqrt(sq) * qn), 10) AS score FROM s JOIN qn USING (item_id) WHERE dot > 0)
SELECT item_id AS query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10""")
def ret_postings_top(spark, sf_dir):
    """The ten best documents for every benchmark text, through the inverted index."""
    index = postings.build(t(spark, sf_dir, "documents"), "doc_id", "text", stop_words=tx.english_stop_words())
    found, _ = postings.search(index, t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), 10)
    return found.select("query", "id", r("score").alias("score"), "rank")


def _asked(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT id, e, CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END AS l FROM v),
 s AS (SELECT q.id AS query, n.id, round(list_dot_product(q.e, n.e) / (q.l * n.l), 10) AS cosine FROM n, n q WHERE q.id % 20 = 0)
 SELECT query, id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)::INT AS rank FROM s QUALIFY rank <= 100""")
def ret1_many_queries(spark, sf_dir):
    """The hundred nearest vectors of each query vector (ids divisible by 20), in one pass over all."""
    found = vector_index.nearest(t(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 100, "vec_id")
    return found.select("query", "id", r("cosine").alias("cosine"), "rank")


@query()
def ret_vector_index(spark, sf_dir):
    """The fifty nearest vectors of each query vector by the inverted file, with the share of all vectors that was read."""
    index = vector_index.build(t(spark, sf_dir, "embeddings"), "vec_id")
    found, read = vector_index.search(index, _asked(spark, sf_dir), 50)
    share = read.select("query", F.round(F.col("read") / float(max(index.n, 1)), 4).alias("share_read"))
    return found.select("query", "id", r("cosine").alias("cosine"), "rank").join(share, "query")


# --- names -------------------------------------------------------------------------------------------------

_NAMES = """names AS (SELECT DISTINCT lower(CASE p_partkey % 4 WHEN 0 THEN p_type || '/' || p_name WHEN 1 THEN p_name || ' ' || p_brand || '-' || p_type WHEN 2 THEN p_name ELSE p_name || ' ' || p_type END) AS name FROM part),
entries AS (SELECT lower(p_name || ' ' || p_type) AS entry, min(p_partkey) AS pos FROM part WHERE p_size > 10 GROUP BY 1)"""


def _part_names(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    other = F.when(kind == 1, F.concat("p_name", F.lit(" "), "p_brand", F.lit("-"), "p_type")).when(kind == 2, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    own = p.select(F.lower(F.when(kind == 0, F.concat("p_type", F.lit("/"), "p_name")).otherwise(other)).alias("text")).distinct()
    entries = p.filter("p_size > 10").groupBy(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text")).agg(F.min("p_partkey").alias("pos"))
    return own, entries


@query(f"WITH {_NAMES} SELECT name, pos FROM names JOIN entries ON name = entry")
def jn7_exact_names(spark, sf_dir):
    own, entries = _part_names(spark, sf_dir)
    return own.join(entries, "text").select(F.col("text").alias("name"), "pos")


@query(rf"""WITH {_NAMES}, n AS (SELECT name, list_distinct([w FOR w IN regexp_split_to_array(name, '[\s/\-]+') IF w <> '']) AS ws FROM names),
 e AS (SELECT entry, pos, list_distinct([w FOR w IN regexp_split_to_array(entry, '[\s/\-]+') IF w <> '']) AS ws FROM entries)
 SELECT name, arg_min(entry, (pos, entry)) AS entry FROM n JOIN e ON list_has_all(n.ws, e.ws) OR list_has_all(e.ws, n.ws) GROUP BY 1""")
def jn9_token_subset(spark, sf_dir):
    return names.subset_names(*_part_names(spark, sf_dir))


def words_of_table(spark, sf_dir, name: str, least: int):
    """The distinct lower-case words of a table's texts, of so many letters a to z at least."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"([a-z]{{{least},}})"), F.lit(1))
    return t(spark, sf_dir, name).select(F.explode(found).alias("text")).distinct()


@query()
def jn8_closest_names(spark, sf_dir):
    """The closest word of all conversations to every word of the benchmark texts, by ratio."""
    return names.closest_names(words_of_table(spark, sf_dir, "benchmark", 5), words_of_table(spark, sf_dir, "conversations", 5))


def word_ontology(spark, sf_dir):
    """An alias for every word of the conversations; words that begin alike have one name."""
    found = words_of_table(spark, sf_dir, "conversations", 4)
    named = found.groupBy(F.substring("text", 1, 5).alias("canonical")).agg(F.sort_array(F.collect_list("text")).alias("aliases"))
    return named.select("canonical", "aliases", F.size("aliases").cast("string").alias("category"), (F.crc32("canonical") % 1_000_000).cast("int").alias("pos"))


@query(r"""WITH al AS (SELECT a, substr(a, 1, 5) AS canonical FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS a FROM conversations)),
 k AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY a) AS n, count(*) OVER (PARTITION BY canonical) AS many FROM al),
 d AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+')) AS a FROM documents)
 SELECT id, canonical AS skill, many::VARCHAR AS category, arg_min(a, n) AS alias FROM d JOIN k USING (a) GROUP BY ALL""")
def res5_many_aliases(spark, sf_dir):
    """Aliases by the tens of thousands, found in every document by the automaton."""
    found = parsing.alias_skills(t(spark, sf_dir, "documents"), "doc_id", "text", word_ontology(spark, sf_dir))
    return found.select("id", "skill", "category", "alias")


# --- hot keys ----------------------------------------------------------------------------------------------

@query("""SELECT CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END AS k, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, count(*) AS n FROM lineitem GROUP BY 1""")
def agg6_hot_groups(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(F.col("l_suppkey")).alias("k"), "l_extendedprice")
    return rk.grouped_percentile(lines, ["k"], "l_extendedprice", 0.95).select("k", r("percentile", 4).alias("p95"), "n")


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 7)::INT AS b FROM orders),
 f AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM f)
 SELECT k, min(a)::VARCHAR AS a, max(b)::VARCHAR AS b, count(*) AS spells FROM i GROUP BY k, isle""")
def win5_hot_key(spark, sf_dir):
    s = t(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).alias("k"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7).cast("int")).alias("b")
    )
    return intervals.merged(s, ["k"], "a", "b").select("k", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "spells")


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k, o_orderpriority, o_orderstatus, o_orderdate, o_orderkey FROM orders),
 y AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY k, lower(o_orderpriority) ORDER BY o_orderdate, o_orderkey) AS p FROM x)
 SELECT k, count(*) FILTER (p IS NOT NULL AND p <> o_orderstatus) AS promotions, count(DISTINCT o_orderpriority) AS companies FROM y GROUP BY 1""")
def win6_hot_key(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")))
    return intervals.promotions(o, ["k"], "o_orderpriority", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("""WITH d AS (SELECT 'CAND_' || lpad(o_orderkey::VARCHAR, 7, '0') AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS rank, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE round(o_totalprice, -3) END AS score FROM orders),
 n AS (SELECT *, lead(score) OVER w AS s2, lead(id) OVER w AS id2 FROM d WINDOW w AS (ORDER BY rank NULLS LAST, id)),
 c AS (SELECT [('row_count', (count(*) <> 100)::BIGINT), ('bad_id', count(*) FILTER (NOT regexp_matches(id, '^CAND_[0-9]{7}$'))), ('repeated_id', count(id) - count(DISTINCT id)), ('bad_rank', count(*) FILTER (rank IS NULL)),
  ('bad_score', count(*) FILTER (score IS NULL)), ('repeated_rank', count(rank) - count(DISTINCT rank)), ('rank_range', count(*) FILTER (rank < 1 OR rank > 100)), ('score_rises', count(*) FILTER (s2 > score)),
  ('tie_order', count(*) FILTER (s2 = score AND id2 < id))] AS p FROM n)
 SELECT x[1] AS problem, x[2] AS n FROM (SELECT unnest(p) AS x FROM c) WHERE x[2] > 0""")
def val1_long_ranking(spark, sf_dir):
    """All rules over a ranking as long as a table."""
    rank, score = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 89 != 0, F.round("o_totalprice", -3))
    rows = t(spark, sf_dir, "orders").select(F.concat(F.lit("CAND_"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("candidate_id"), rank.cast("string").alias("rank"), score.cast("string").alias("score"), F.lit("x").alias("reasoning"))
    return validate.ranking_problems(rows)


def job_log(events):
    """Events as a log of ranking jobs: users are jobs, what they do is what happens to those."""
    kind = F.when(F.col("event_type") == "click", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "finish").otherwise(F.col("event_type"))
    return events.select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), "event_id")


@query("""WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS seen FROM events GROUP BY 1),
 s AS (SELECT *, CASE e WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'unknown' END AS st FROM n)
 SELECT user_id::VARCHAR AS job, CASE WHEN st IN ('pending', 'processing') AND seen + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) THEN 'stalled' ELSE st END AS status, event_id FROM s""")
def flt21_job_statuses(spark, sf_dir):
    """The status of every job of the event log; ``streaming.statuses.follow`` gives the same as events come."""
    log = job_log(t(spark, sf_dir, "events"))
    until = log.agg(F.max("at") - F.expr("INTERVAL 10 MINUTES")).scalar()
    return statuses.status_of(log, "1 day", until).select("job", "status", "event_id")


# --- the pool ranking with retrieval and a model -------------------------------------------------------------

_WHOLE = base._POOL.replace("ps AS (", "p0 AS (", 1).replace("pp AS (", "pp0 AS (", 1).replace("FROM ps)", "FROM p0)", 1)
_REAL = f"""{_WHOLE}, {base._LEX_OF_PROFILES}, {base._DENSE_OF_PROFILES},
un AS (SELECT id FROM (SELECT id FROM dense ORDER BY cosine DESC, id LIMIT 5000) UNION SELECT id FROM (SELECT id FROM lex ORDER BY lexical DESC, id LIMIT 5000)),
p1 AS (SELECT p.* EXCLUDE (semantic_sim), coalesce(least(greatest(cosine, 0), 1), semantic_sim)::DOUBLE AS semantic_sim, least(greatest(coalesce(lexical, 0) / ((SELECT quantile_cont(lexical, 0.99) FROM lex) + 1e-9), 0), 1)::DOUBLE AS bm25_score
  FROM p JOIN un ON un.id = p.candidate_id LEFT JOIN dense ON dense.id = p.candidate_id LEFT JOIN lex ON lex.id = p.candidate_id),
ps AS (SELECT *, CASE WHEN bm25_score > 0.6 AND title_similarity = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS keyword_stuffing_risk FROM p1),
"""
_PACK = """b AS (SELECT * FROM pp ORDER BY pool_score DESC, candidate_id LIMIT 100)
 SELECT candidate_id, round(CASE WHEN max(pool_score) OVER () = min(pool_score) OVER () THEN 0.5 ELSE (pool_score - min(pool_score) OVER ()) / (max(pool_score) OVER () - min(pool_score) OVER ()) END * 100, 2) AS final_score,
 row_number() OVER (ORDER BY pool_score DESC, candidate_id)::INT AS rank FROM b"""


def small_model() -> tree_model.TreeModel:
    return tree_model.parse_model(files("sieveline.plans").joinpath("small_ranker.txt").read_text(encoding="utf-8"))


def _whole_pool(spark, sf_dir, predict=None):
    vectors = t(spark, sf_dir, "embeddings").select(F.format_string("CAND_%07d", "vec_id").alias("id"), "embedding")
    return rankings.pool_ranking(candidates(spark, sf_dir), vectors, base.query_vector(spark, sf_dir), base.QUERY, SPEC, predict, anti=base._ANTI)


@query(_REAL + """pp AS (SELECT *, round(4.95 * title_similarity + 2.18 * semantic_sim + 1.23 * skill_coverage + 0.88 * seniority_alignment + 0.81 * quality_score + 0.62 * bm25_score - 7.31 * keyword_stuffing_risk
  + 0.5 * (hireability_score + startup_readiness_score + behavioral_reliability_score), 6) AS pool_score FROM ps), """ + _PACK)
def s4_whole_ranking(spark, sf_dir):
    """The pool ranking as one plan: both retrievals, their union, features, linear score, the best hundred."""
    return _whole_pool(spark, sf_dir).select("candidate_id", "final_score", "rank")


@query(_REAL + f"pp AS (SELECT *, round({tree_model.as_sql(small_model())}, 6) AS pool_score FROM ps), " + _PACK)
def s4_model_ranking(spark, sf_dir):
    """The same with the score of a saved tree ensemble."""
    return _whole_pool(spark, sf_dir, tree_model.predictor(small_model())).select("candidate_id", "final_score", "rank")


@query(base._POOL + f", m AS (SELECT *, semantic_sim AS bm25_score FROM ps) SELECT candidate_id, round({tree_model.as_sql(small_model())}, 6) AS pool_score FROM m")
def p12_model_scores(spark, sf_dir):
    """A saved tree ensemble over the features of every profile."""
    wide = pool.pool_features(candidates(spark, sf_dir), SPEC, anti=base._ANTI)
    return pool.model_score(wide, tree_model.predictor(small_model())).select("candidate_id", r("pool_score").alias("pool_score"))
