"""Every registered query of the library itself against its SQL in another engine."""

import duckdb
import pytest

from sieveline.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, con, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    if name in q.ORACLES:
        want = con.sql(q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert name in ("tax1_normalise", "s1_relative_ranking", "ret_vector_index", "jn8_closest_names")  # tested below and in test_scale.py, for want of SQL


def test_names_by_plain_python(spark, sf):
    """Every part's name: exact alias, else difflib's closest, else words within words, else none."""
    import re
    from difflib import get_close_matches

    known = sorted(((c.lower() if a is None else a.lower(), c, p) for c, al, _, p in q._taxonomy(spark).collect() for a in (None, *al)), key=lambda x: (x[2], x[0]))
    of = {a: c for a, c, _ in known}
    for r in q.QUERIES["tax1_normalise"](spark, sf).collect():
        key = r.name.strip().lower()
        near = get_close_matches(key, list(of), n=1, cutoff=0.75)
        own = set(filter(None, re.split(r"[\s/\-]+", key)))
        inside = [c for a, c, _ in known if (w := set(filter(None, re.split(r"[\s/\-]+", a)))) <= own or own <= w]
        want = (of[key], "exact") if key in of else (of[near[0]], "fuzzy") if near else (inside[0], "subset") if inside else (None, "none")
        assert (r.canonical, r.method) == want, r.name


def test_reasons_of_the_whole_ranking(spark, sf):
    """Places and scores are those of the query with SQL; openers rotate with the rank; every reason names its years."""
    got = q.QUERIES["s1_relative_ranking"](spark, sf).orderBy("rank").collect()
    assert [(r.candidate_id, r.score, r["rank"]) for r in got] == [(r.candidate_id, r.score, r["rank"]) for r in q.QUERIES["s1_relative_scores"](spark, sf).orderBy("rank").collect()]
    shapes = (r" with [0-9.]+ yrs' experience\.", r"^[0-9.]+-year ", r" \([0-9.]+ yrs\)\.", r"^Experienced .*, [0-9.]+ yrs\.")
    import re

    assert all(re.search(shapes[(r["rank"] - 1) % 4], r.reasoning) for r in got) and len(got) > 50
