"""Registered queries that put every fixed pattern, title and rule to work over table rows, and changes of stored tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.operators import compare, extract, families, features, parsing, records
from sieveline.operators.titles import TITLES
from sieveline.plans import queries as base
from sieveline.plans.candidates import ROLES, SKILLS, SPEC, candidates
from sieveline.plans.registry import query, r, t
from sieveline.sources.buckets import BucketTable
from sieveline.storage import scratch_path


def example(pattern: str) -> str:
    """A text that a pattern finds: its first alternative, written plainly."""
    depth, first = 0, ""
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            break
        first += c
    first = re.sub(r"\(([^|)]*)\|[^)]*\)", r"\1", first)
    for mark, plain in ((r"\s+", " "), (".*?", " x "), (r"\b", ""), (r"\+", "+"), (r"\s*", ""), (r"\.?", ""), (r"\.", ".")):
        first = first.replace(mark, plain)
    return first


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _found(patterns: dict[str, str]) -> str:
    """The names of the patterns that a text holds, in their order, in SQL."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, {_quoted('(?i)' + p)}) THEN {_quoted(n)} END" for n, p in patterns.items()) + ")"


def _two_in_sql(patterns: dict[str, str], key: str) -> str:
    """A text of two examples that a key picks."""
    n, listed = len(patterns), "[" + ", ".join(_quoted(example(p)) for p in patterns.values()) + "]"
    return f"({listed}[{key} % {n} + 1] || ' of ' || {listed}[{key} // {n} % {n} + 1])"


def _two_examples(patterns: dict[str, str], key: str) -> Column:
    """The same text as a column."""
    n, array, k = len(patterns), F.array(*(F.lit(example(p)) for p in patterns.values())), F.col(key)
    return F.concat(F.get(array, (k % n).cast("int")), F.lit(" of "), F.get(array, (F.floor(k / n) % n).cast("int")))


@query(f"SELECT o_orderkey, {_found(records.CERTIFICATES)} AS names FROM (SELECT o_orderkey, {_two_in_sql(records.CERTIFICATES, 'o_orderkey')} || ', ' || o_orderpriority AS text FROM orders)")
def res14_all_certificates(spark, sf_dir):
    """Every pattern of a certificate, in pairs."""
    got = t(spark, sf_dir, "orders").select("o_orderkey", records.certificates(F.concat(_two_examples(records.CERTIFICATES, "o_orderkey"), F.lit(", "), "o_orderpriority")).alias("c"))
    return got.select("o_orderkey", F.array_join(F.transform("c", lambda c: c["name"]), ",").alias("names"))


@query(f"SELECT o_orderkey, {_found(extract.DEGREES)} AS degrees FROM (SELECT o_orderkey, {_two_in_sql(extract.DEGREES, 'o_orderkey')} || ' 1' AS text FROM orders)")
def res13_all_degrees(spark, sf_dir):
    """Every pattern of a degree, in pairs."""
    got = t(spark, sf_dir, "orders").select("o_orderkey", parsing.education(F.concat(_two_examples(extract.DEGREES, "o_orderkey"), F.lit(" 1"))).alias("e"))
    return got.select("o_orderkey", F.array_join(F.transform("e", lambda e: e["degree"]), ",").alias("degrees"))


_TITLE_ROWS = ", ".join(f"({i}, {_quoted(a)}, {_quoted(c)})" for i, (a, c) in enumerate(TITLES.items()))
_TITLE_COUNT = len(TITLES)


@query(f"""WITH m(i, a, c) AS (VALUES {_TITLE_ROWS}), al AS (SELECT DISTINCT lower(p_type) AS a, p_type || ' Lead' AS c FROM part WHERE length(p_type) >= 6),
 x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' ' || upper(m.a) WHEN 1 THEN 'head of ' || lower(p_type) || ' and ' || p_name ELSE p_name END AS title
  FROM orders JOIN m ON m.i = o_orderkey // 3 % {_TITLE_COUNT} JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
 k AS (SELECT *, lower(trim(title)) AS low FROM x),
 b AS (SELECT low, arg_max(al.c, (length(al.a), al.a)) AS part FROM (SELECT DISTINCT low FROM k) JOIN al ON contains(low, al.a) GROUP BY 1)
 SELECT o_orderkey, coalesce(m.c, al.c, b.part, title) AS normalised, CASE WHEN m.c IS NOT NULL THEN 'hardcoded' WHEN al.c IS NOT NULL THEN 'alias' WHEN b.part IS NOT NULL THEN 'partial' ELSE 'none' END AS method
 FROM k LEFT JOIN m ON m.a = low LEFT JOIN al ON al.a = low LEFT JOIN b ON b.low = k.low""")
def res6_all_titles(spark, sf_dir):
    """Every fixed title, and titles that hold an alias."""
    part = t(spark, sf_dir, "part")
    n = part.count()
    titles = F.array(*map(F.lit, TITLES))
    key = F.col("o_orderkey")
    joined = t(spark, sf_dir, "orders").select("o_orderkey").join(part.select("p_partkey", "p_name", "p_type"), F.col("p_partkey") == key % n)
    title = F.when(key % 3 == 0, F.concat(F.lit(" "), F.upper(F.get(titles, (F.floor(key / 3) % _TITLE_COUNT).cast("int")))))
    title = title.when(key % 3 == 1, F.concat(F.lit("head of "), F.lower("p_type"), F.lit(" and "), "p_name")).otherwise(F.col("p_name"))
    fixed = spark.createDataFrame(list(TITLES.items()), "alias string, canonical string")
    aliases = part.filter(F.length("p_type") >= 6).select(F.lower("p_type").alias("alias"), F.concat("p_type", F.lit(" Lead")).alias("canonical")).distinct()
    return records.normalise_titles(joined.select("o_orderkey", title.alias("title")), "title", fixed, aliases).select("o_orderkey", "normalised", "method")


@query(base._FAM + "SELECT candidate_id, " + ", ".join(f"round({w} * {'0.8 * semantic_sim' if k == 'bm25_score' else k}, 6)::DOUBLE AS {k}_contribution" for k, w in specs.FAMILY_WEIGHTS.items()) + " FROM g")
def prj11_contributions(spark, sf_dir):
    """What each feature of the family ranking adds to its score."""
    texts = features.with_texts(candidates(spark, sf_dir))
    texts = texts.withColumn("current_title", F.lower(F.coalesce(F.get("__career", F.lit(0))["title"], F.lit("")))).withColumn("quality_score", features.quality_score())
    wide = families.family_features(texts, SPEC, ROLES, SKILLS)
    return wide.select("candidate_id", *(r(c).cast("double").alias(n) for n, c in families.contributions().items()))


_ROLE = extract.ROLE.replace("'", "''")


@query(rf"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN p_name || ' - Senior ' || p_type || ' Engineer at ' || p_brand WHEN 1 THEN p_brand || ' | ' || p_name || ' lead | vp' WHEN 2 THEN p_name || ' at ' || p_brand WHEN 3 THEN 'manager' ELSE '' END AS raw
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
 s AS (SELECT o_orderkey, [trim(p) FOR p IN regexp_split_to_array(raw, '\s+[-–—|]\s+|\s+at\s+|\s*\|\s*') IF trim(p) <> ''] AS ps FROM x),
 f AS (SELECT *, list_sort([{{'n': length(p), 'p': p}} FOR p IN ps IF regexp_matches(p, '{_ROLE}')])[1].p AS role FROM s)
 SELECT o_orderkey, coalesce(role, ps[1], '') AS title FROM f""")
def res12_clean_titles(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    n, key = part.count(), F.col("o_orderkey")
    joined = t(spark, sf_dir, "orders").select("o_orderkey").join(part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("p_partkey") == key % n)
    raw = (
        F.when(key % 5 == 0, F.concat("p_name", F.lit(" - Senior "), "p_type", F.lit(" Engineer at "), "p_brand")).when(key % 5 == 1, F.concat("p_brand", F.lit(" | "), "p_name", F.lit(" lead | vp")))
        .when(key % 5 == 2, F.concat("p_name", F.lit(" at "), "p_brand")).when(key % 5 == 3, F.lit("manager")).otherwise(F.lit(""))
    )
    return joined.select("o_orderkey", extract.clean_title(raw).alias("title"))


@query("""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, n_chars % 100 / 100.0::DOUBLE AS complexity FROM documents),
 s AS (SELECT *, round(greatest(0.55, 1 - 0.35 * complexity) + 1e-9, 2) AS confidence FROM c)
 SELECT doc_id, confidence::DOUBLE AS confidence, sha256(CASE WHEN confidence < 0.8 THEN text ELSE '' END) AS kept_sha256, concat_ws(',', CASE WHEN complexity > 0.8 THEN 'very complex layout' END, CASE WHEN complexity > 0.6 THEN 'complex layout' END) AS warnings FROM s""")
def res19_raw_texts(spark, sf_dir):
    """Texts that are kept as they are, where what was read out of them is unsure."""
    complexity = F.col("n_chars") % 100 / 100.0
    docs = t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), complexity.alias("complexity")).withColumn("confidence", extract.extraction_confidence(F.col("complexity")))
    kept = extract.raw_text_kept(F.col("text"), F.col("confidence"))
    return docs.select("doc_id", "confidence", F.sha2(kept, 256).alias("kept_sha256"), F.array_join(extract.layout_warnings(F.col("complexity")), ",").alias("warnings"))


@query("""WITH s AS (SELECT o_custkey AS id, CASE WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent') THEN o_orderpriority END AS hit FROM orders)
 SELECT id, coalesce(string_agg(DISTINCT hit, ',' ORDER BY hit), '') AS found FROM s GROUP BY 1""")
def mat1_domain_found_in(spark, sf_dir):
    """Companies of the spells that name a wanted domain."""
    spells = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("description"))).alias("e"))
    return spells.select("id", F.array_join(compare.domain_found_in(F.lit("URGENT"), F.col("e")), ",").alias("found"))


@query("""WITH v AS (SELECT event_id % 500 AS k, event_id % 4 AS step, event_id, event_type, value FROM events),
 n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, step ORDER BY event_id DESC) = 1)
 SELECT k, event_id, value FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY step DESC) = 1 AND event_type <> 'error'""")
def snk9_bucketed_upserts(spark, sf_dir):
    """Four rounds of upserts and deletions of a bucketed table: what is live in the end."""
    every = t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("k"), (F.col("event_id") % 4).alias("step"), "event_id", "event_type", "value")
    newest = every.groupBy("k", "step").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e")).select("k", "step", "e.*")
    table = BucketTable(spark, scratch_path(spark, "bucket-table"), ("k",), "k long, event_id long, value double", 16)
    for step in range(4):
        here = newest.filter(F.col("step") == step)
        if step:
            table.upsert(here.filter("event_type <> 'error'"))
            table.delete(here.filter("event_type = 'error'"))
        else:
            table.create(here.filter("event_type <> 'error'"))
    return table.read()
