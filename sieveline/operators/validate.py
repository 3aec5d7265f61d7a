"""Checks of a ranked result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.scan import running
from sieveline.storage import stored


def ranking_problems(df: DataFrame, rows: int = 100, id_pattern: str = r"^CAND_[0-9]{7}$") -> DataFrame:
    """problem, n: a row for each rule that is broken.

    df: candidate_id, rank, score, reasoning as text, any number of rows: they are range-partitioned by rank, and the last
    row of each partition is carried into the next.
    """
    typed = df.select("candidate_id", F.expr("try_cast(rank AS INT)").alias("rank"), F.expr("try_cast(score AS DOUBLE)").alias("score"))
    typed = typed.withColumns({"__all": F.lit(0), "__none": F.col("rank").isNull()})
    ordered = running(typed, ["__all"], ["__none", "rank", "candidate_id"], previous={"last_score": F.col("score"), "last_id": F.col("candidate_id")})
    found = ordered.agg(
        (F.count("*") != rows).cast("long").alias("row_count"),
        F.count_if(~F.coalesce(F.col("candidate_id").rlike(id_pattern), F.lit(False))).alias("bad_id"),
        (F.count("candidate_id") - F.countDistinct("candidate_id")).alias("repeated_id"),
        F.count_if(F.col("rank").isNull()).alias("bad_rank"), F.count_if(F.col("score").isNull()).alias("bad_score"),
        (F.count("rank") - F.countDistinct("rank")).alias("repeated_rank"), F.count_if((F.col("rank") < 1) | (F.col("rank") > rows)).alias("rank_range"),
        F.count_if(F.col("score") > F.col("last_score")).alias("score_rises"),
        F.count_if((F.col("score") == F.col("last_score")) & (F.col("candidate_id") < F.col("last_id"))).alias("tie_order"),
    )
    return found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in found.columns)))).filter("n > 0")


def _with_seen(ranked: DataFrame) -> DataFrame:
    """Adds __seen, the relevance up to each rank: within range partitions, plus the sums of those before."""
    parts = stored(ranked.select("rank", "relevance").repartitionByRange("rank").withColumn("__part", F.spark_partition_id()), "seen")
    sums = parts.groupBy("__part").agg(F.coalesce(F.sum("relevance"), F.lit(0)).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    own = F.sum("relevance").over(Window.partitionBy("__part").orderBy("rank"))
    placed = parts.withColumn("__own", own).join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
    return placed.withColumn("__seen", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def composite_quality(ranked: DataFrame) -> DataFrame:
    """One row: NDCG@10, NDCG@50, average precision, precision@5 and their composite, of (rank, relevance 0/1).

    The ideal order needs the number of relevant rows only.
    """
    gain = F.col("relevance") / F.log2(F.col("rank") + 1.0)
    sums = _with_seen(ranked).agg(
        F.sum("relevance").cast("long").alias("relevant"), *(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg{k}") for k in (10, 50)),
        F.sum(F.when(F.col("relevance") > 0, F.col("__seen") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        (F.sum(F.when(F.col("rank") <= 5, F.col("relevance")).otherwise(0)) / 5.0).alias("p5"),
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    safe = lambda x: F.when(F.col("relevant") > 0, x).otherwise(0.0)
    out = sums.select(safe(F.col("dcg10") / ideal(10)).alias("ndcg10"), safe(F.col("dcg50") / ideal(50)).alias("ndcg50"), safe(F.col("precisions") / F.greatest("relevant", F.lit(1))).alias("average_precision"), "p5")
    return out.withColumn("composite", 0.5 * F.col("ndcg10") + 0.3 * F.col("ndcg50") + 0.15 * F.col("average_precision") + 0.05 * F.col("p5"))
