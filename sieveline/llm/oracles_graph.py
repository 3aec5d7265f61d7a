"""SQL for the filter audit, the prefix trie and the URL filters."""

from __future__ import annotations

from sieveline.llm import filter_audit as fa
from sieveline.llm import url_filters as uf

AUDIT = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n,
           [len(words) < {fa.MIN_WORDS}, 100 * len(list_distinct(words)) < {fa.MIN_DISTINCT_PERCENT} * len(words),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {fa.MAX_CAPITALS_PERCENT} * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
    FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL
),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) f(c) WHERE length(o) < 5 AND NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s::INT AS step, [ascii(c) - 64 FOR c IN string_split(o[:s - 1], '') IF c <> ''] AS applied, ascii(o[s]) - 64 AS f FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
x AS (
    SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own, len([a FOR a IN applied IF fails[a]]) > 0 AS earlier, len([b FOR b IN fails IF b]) AS failed FROM m, steps
),
y AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN own AND NOT earlier THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT earlier THEN n * toxic ELSE 0 END) AS toxic_lost
    FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM y
"""

#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(c::VARCHAR, '') IF ch <> '']),
              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

TRIE = f"""
WITH o AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
),
h AS (SELECT c, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (
    SELECT h.c, 0 AS part, o.p, o.role, o.text FROM h JOIN o ON o.c = h.base WHERE o.p <= h.h
    UNION ALL SELECT h.c, 1, o.p, o.role, o.text FROM h JOIN o USING (c) WHERE o.p > h.h
),
t AS (
    SELECT *, row_number() OVER w AS depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER w) AS k
    FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)
),
m AS (SELECT c, depth, k, text FROM t UNION ALL SELECT c, 0, '', '' FROM h),
e AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
n AS (
    SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS own,
           coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (c IN (SELECT c FROM e WHERE e.depth = m.depth)), '') AS ends
    FROM m GROUP BY depth, k
),
up AS (SELECT n.depth, n.k, n.conv_id, a.k AS parent_k FROM n JOIN m a ON a.c = n.conv_id AND a.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM up GROUP BY ALL),
sub AS (
    SELECT a.depth, a.k, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
    FROM n LEFT JOIN kids USING (depth, k) JOIN m a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, x.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN kids USING (depth, k) JOIN sub USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN n x ON x.depth = n.depth - 1 AND x.k = up.parent_k
"""


def _ranks(name: str, links: str, seeds: str) -> str:
    """CTEs of one propagation: shares, arcs, then a pair for each round."""
    whole = lambda x: f"floor({x})::BIGINT"
    out = f"""
{name}_s AS MATERIALIZED (SELECT host, n / (sum(n) OVER ())::DOUBLE AS share FROM ({seeds})),
{name}_a AS MATERIALIZED (SELECT src, dst, n / (sum(n) OVER (PARTITION BY src))::DOUBLE AS weight FROM ({links})),
{name}_0 AS MATERIALIZED (SELECT host, {whole(f"share * {float(uf.UNITS)!r}")} AS rank FROM {name}_s),"""
    for i in range(uf.ROUNDS):
        out += f"""
{name}_c{i} AS MATERIALIZED (SELECT dst AS host, sum({whole(f"rank::DOUBLE * weight * {uf.DAMPING!r}")})::BIGINT AS rank FROM {name}_{i} JOIN {name}_a ON host = src GROUP BY dst),
{name}_{i + 1} AS MATERIALIZED (
    SELECT host, sum(rank)::BIGINT AS rank FROM (
        SELECT * FROM {name}_c{i}
        UNION ALL SELECT host, {whole(f"share * ({uf.UNITS} - coalesce((SELECT sum(rank) FROM {name}_c{i}), 0))::DOUBLE")} FROM {name}_s
    ) GROUP BY host
),"""
    return out


def _urls(rules: tuple[uf.Rule, ...]) -> str:
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    values = ", ".join(f"('{r.prefix.partition('/')[0]}', '/{r.prefix.partition('/')[2]}', '{r.prefix}', {r.allow})" for r in rules)
    href = uf.HREF.replace("'", "''")
    return rf"""
WITH RECURSIVE rules(h, p, rule, allow) AS (VALUES {values}),
u AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '^(?:.|\n)*?://([^/?#]*)', 1), {lower}) AS host,
           regexp_extract(coalesce(url, ''), '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
hit AS (SELECT rid, arg_max(rule, (length(rule), length(h), NOT allow, rule)) AS rule, arg_max(allow, (length(rule), length(h), NOT allow, rule)) AS allow
        FROM u JOIN rules ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
j AS MATERIALIZED (SELECT u.rid, page_id, host, path, rule, allow FROM u LEFT JOIN hit USING (rid)),
found AS (SELECT src, translate(d, {lower}) AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS d FROM u WHERE host <> '')),
known AS (SELECT host FROM j WHERE host <> '' UNION SELECT dst FROM found WHERE src <> dst),
up AS (SELECT host AS low, substr(host, strpos(host, '.') + 1) AS high FROM known WHERE contains(substr(host, strpos(host, '.') + 1), '.') AND contains(host, '.')
       UNION SELECT high, substr(high, strpos(high, '.') + 1) FROM up WHERE contains(substr(high, strpos(high, '.') + 1), '.')),
links AS MATERIALIZED (
    SELECT src, dst, sum(n)::BIGINT AS n FROM (
        SELECT src, dst, count(*) AS n FROM found WHERE src <> dst GROUP BY ALL
        UNION ALL SELECT low, high, {uf.DOMAIN_LINKS} FROM up UNION ALL SELECT high, low, {uf.DOMAIN_LINKS} FROM up
    ) GROUP BY src, dst
),
{_ranks("t", "SELECT src, dst, n FROM links", "SELECT host, count(*) AS n FROM j WHERE allow AND host <> '' GROUP BY host")}
{_ranks("d", "SELECT dst AS src, src AS dst, n FROM links", "SELECT host, count(*) AS n FROM j WHERE NOT allow AND host <> '' GROUP BY host")}
nodes AS (SELECT count(*) AS n FROM (SELECT host FROM j WHERE host <> '' UNION SELECT src FROM links UNION SELECT dst FROM links)),
bad AS (
    SELECT d_{uf.ROUNDS}.host FROM d_{uf.ROUNDS} LEFT JOIN t_{uf.ROUNDS} USING (host), nodes
    WHERE d_{uf.ROUNDS}.rank > coalesce(t_{uf.ROUNDS}.rank, 0) AND d_{uf.ROUNDS}.rank::DOUBLE * nodes.n::DOUBLE >= {float(uf.LEAST * uf.UNITS)!r}
)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, host NOT IN (SELECT host FROM bad)) THEN 'allow' ELSE 'block' END AS verdict FROM j
"""


#: The rules that the registered query applies.
RULES = (
    uf.Rule("com/", True),
    uf.Rule("example.com/en/", False),
    uf.Rule("www.example.com/en/", True),
    uf.Rule("net/es/", False),
    uf.Rule("net/fr/", False),
)
URLS = _urls(RULES)
