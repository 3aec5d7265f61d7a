"""Scratch tables and rows kept by key."""

import pytest
from pyspark.sql import functions as F

from sieveline.llm import common


def test_scratch_is_cleared(spark):
    before = common.scratch_paths()
    df = common.stored(spark.range(5), "test")
    assert df.count() == 5
    new = [p for p in common.scratch_paths() if p not in before]
    assert len(new) == 1
    common.clear_scratch(spark, new)
    assert common.scratch_paths() == before


def test_scopes_keep_their_own_paths(spark):
    before = common.scratch_paths()
    with common.scratch_scope() as outer:
        common.stored(spark.range(1), "outer")
        with common.scratch_scope() as inner:
            common.stored(spark.range(2), "inner")
            kept = common.stored(spark.range(3), "inner")
            common.clear_scratch(spark, inner[:-1])
            assert len(inner) == 1 and kept.count() == 3
        assert len(outer) == 2
        common.clear_scratch(spark)
        assert common.scratch_paths() == []
    assert common.scratch_paths() == before


@pytest.mark.parametrize("few", [100, 0])
def test_keep_rows(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, None), (3, "alone")], "id long, text string")
    rows = [(1, "a", True), (1, "a", False), (1, "b", False), (None, "c", True), (None, "c", True), (2, None, False), (9, "x", True)]
    got = common.keep_rows(docs, spark.createDataFrame(rows, "id long, t string, kept boolean"), {"id": F.col("id"), "t": F.col("text")})
    assert got.columns == ["id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (3, "alone"), (None, "c")]
    none = spark.createDataFrame([], "id long, t string, kept boolean")
    assert common.keep_rows(docs, none, {"id": F.col("id"), "t": F.col("text")}).count() == 7
