"""SQL for operators that another engine can express."""

from __future__ import annotations

from sieveline.llm import license_scan as ls


def _base32(digest: str) -> str:
    """Base32 of 40 hexadecimal digits: five digits are four characters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    group = lambda g: f"('0x' || substr({digest}, {5 * g + 1}, 5))::INT"
    return " || ".join(f"substr({letters}, (({group(g)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, {_base32("digest")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, NULL::VARCHAR AS problem FROM h
"""


def _license() -> str:
    k = ls.GRAM
    templates = ", ".join(f"({i}, '{x.label}', {x.coverage}, {list(x.words)!r}, {ls.needed_places(x)!r}::INT[], {list(ls.UNLIKE.get(x.label, ()))!r}::VARCHAR[])" for i, x in enumerate(ls.TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT rid, p, '{label}' AS label FROM g WHERE " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(p.split())) for p, label in ls.PHRASES
    )
    heads = ", ".join(f"lead(w, {i}) OVER (PARTITION BY rid ORDER BY p) AS w{i}" for i in range(k))
    same = " AND ".join(f"w{i} = ws[q + {i + 1}]" for i in range(k))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tok AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM d),
g AS (SELECT rid, p, {heads} FROM tok),
ph AS ({phrases}),
base AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ph GROUP BY 1),
tpl(t, label, share, ws, needed, unlike) AS (VALUES {templates}),
tg AS (SELECT t, ws, unnest(range(len(ws) - {k - 1})) AS q FROM tpl),
votes AS (SELECT rid, t, p, q, p - q AS diagonal FROM g JOIN tg ON {same}),
lines AS (SELECT rid, t, diagonal, min(p) AS f, max(p) AS l FROM votes GROUP BY ALL),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {ls.NEAR} OR f - lag(l) OVER w > {k + ls.NEAR} THEN 1 ELSE 0 END AS apart FROM lines WINDOW w AS (PARTITION BY rid, t ORDER BY diagonal)),
band AS (SELECT *, sum(apart) OVER (PARTITION BY rid, t ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS b FROM cut),
cov AS (SELECT v.rid, v.t, b, min(v.p) AS f, max(v.p) + {k} AS l, list(DISTINCT v.q + o) AS places FROM votes v JOIN band USING (rid, t, diagonal), range({k}) r(o) GROUP BY ALL),
telling AS (SELECT DISTINCT rid, p, w0 FROM g WHERE list_contains({list(ls.TELLING)!r}, w0)),
spans AS (
    SELECT rid, label, len(places) / len(ws)::DOUBLE AS score FROM cov JOIN tpl USING (t)
    WHERE len(places) / len(ws)::DOUBLE >= share AND len(places) >= {ls.DENSITY} * (l - f) AND list_has_all(places, needed)
      AND NOT EXISTS (SELECT 1 FROM telling x WHERE x.rid = cov.rid AND x.p BETWEEN f AND l - 1 AND list_contains(unlike, x.w0))
),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM ph UNION ALL SELECT rid, label FROM spans) GROUP BY 1),
best AS (SELECT rid, max(score) AS score FROM spans GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)
"""


LICENSE = _license()
