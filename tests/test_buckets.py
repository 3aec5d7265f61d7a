"""A bucketed table after rounds of changes against a dictionary."""

import random

from sieveline.sources.buckets import BucketTable

SCHEMA = "k int, v string, n long"


def test_rounds_of_changes(spark, tmp_path):
    rng = random.Random(6)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    start = [(k, f"v{k}", 0) for k in range(300)] + [(None, "none", 0), (5, "zz", 0)]
    table = BucketTable(spark, str(tmp_path / "t"), ("k",), SCHEMA, 16)
    table.create(frame(start))
    want = {k: (k, v, n) for k, v, n in start}
    for step in range(4):
        new = [(k, f"w{step}", step) for k in rng.sample(range(400), 6)] + ([(None, "again", step)] if step == 2 else [])
        assert 0 < table.upsert(frame(new)) <= len(new)
        want |= {r[0]: r for r in new}
        gone = rng.sample(range(400), 5) + ([None] if step == 3 else [])
        assert 0 < table.delete(spark.createDataFrame([(k,) for k in gone], "k int")) <= len(gone)
        for k in gone:
            want.pop(k, None)
        assert sorted(map(tuple, table.read().collect()), key=str) == sorted(want.values(), key=str)
    assert table.upsert(frame([])) == 0 == table.delete(spark.createDataFrame([], "k int"))
    # Versions that are appended only, until compaction.
    for step in range(1, 7):
        new = [(k, f"x{step}", step) for k in rng.sample(range(400), 40)]
        table.append(frame(new), step)
        want |= {r[0]: r for r in new}
    table.append(spark.createDataFrame([(1,), (2,)], "k int"), 7, gone=True)
    want.pop(1, None), want.pop(2, None)
    live = sorted(want.values(), key=str)
    assert sorted(map(tuple, table.read().collect()), key=str) == live
    assert 0 < table.compact(2) <= 16 and table.compact(2) == 0
    assert sorted(map(tuple, table.read().collect()), key=str) == live


def test_a_bucket_that_empties(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ("k",), SCHEMA, 2)
    table.create(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    table.delete(spark.createDataFrame([(1,)], "k int"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "b", 2), (1, "a", 9)], SCHEMA))
    assert [tuple(r) for r in table.read().collect()] == [(1, "b", 2)]
