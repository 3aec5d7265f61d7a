"""Ranking metrics are over the whole ranking, without one window over everything."""

from sieveline.operators import validate
from sieveline.plans import queries as q


def test_all_labels_count(spark, tmp_path):
    n = 1_200_000  # the relevant rows are the last
    spark.range(n).selectExpr("id AS doc_id", f"CAST(id >= {n - 100_000} AS INT) AS quality").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    got = q.ir_metrics(spark, str(tmp_path)).first()
    want = sum((i + 1) / (n - 100_000 + i + 1) for i in range(100_000)) / 100_000
    assert got.average_precision == round(want, 6) and got.p5 == 0


def test_seen_by_partitions(spark):
    rows = [(i + 1, i % 3 % 2) for i in range(500)]
    seen, total = {}, 0
    for rank, rel in rows:
        seen[rank] = total = total + rel
    df = spark.createDataFrame(rows, "rank long, relevance int").repartition(7)
    assert {r.rank: r["__seen"] for r in validate._with_seen(df).collect()} == seen
