"""Running values by key that don't need a key's rows in one task.

A window by key puts all rows of a key into one task, however many they are. Here rows are range-partitioned by
(key, order), so that a large key is spread over as many partitions as its rows need; each partition computes its own
running values, and what a key has reached at the end of one partition is carried into the next. Only keys that span
partitions have anything to carry: at most one row for each end of a partition, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import stored

CHUNK = "__chunk"


def spread(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` range-partitioned by (key, order), stored, with the number of its partition as ``__chunk``.

    Nulls come first. Rows that agree on key and order can't be told apart and stay together.
    """
    return stored(df.repartitionByRange(*key, *order).withColumn(CHUNK, F.spark_partition_id()), "spread")


def carried(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """key, chunk and aggregates for the keys that span several chunks: no more rows than chunks have ends, twice."""
    spans = rows.groupBy(*key).agg(F.min(CHUNK).alias("__low"), F.max(CHUNK).alias("__high")).filter("__low < __high")
    spans = F.broadcast(spans.select(*(F.col(k).alias(f"__k_{k}") for k in key)))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]
    return rows.join(spans, same, "left_semi").groupBy(*key, CHUNK).agg(*(v.alias(n) for n, v in values.items()))


def running(
    df: DataFrame, key: list[str], order: list[str], total: dict[str, Column] | None = None, reached: dict[str, Column] | None = None, previous: dict[str, Column] | None = None
) -> DataFrame:
    """Adds running values over the rows of a key in ``order`` (ascending, nulls first), which should be total.

    Rows that ``spread`` has dealt by the same key and order stay where they are.

    total: sums up to and including the row (nulls count nothing; none so far: null). reached: the largest value of the rows
    before, null for none. previous: the value of the row before, null for the first.
    """
    total, reached, previous = total or {}, reached or {}, previous or {}
    sources = {f"__v_{n}": c for part in (total, reached, previous) for n, c in part.items()}
    rows = df.withColumns(sources) if CHUNK in df.columns else spread(df.withColumns(sources), key, order)
    here = Window.partitionBy(CHUNK, *key).orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__own_{n}": F.sum(f"__v_{n}").over(upto) for n in total}
    own |= {f"__own_{n}": F.max(f"__v_{n}").over(before) for n in reached}
    own |= {f"__own_{n}": F.lag(f"__v_{n}").over(here) for n in previous}
    local = rows.withColumns(own | {"__first": F.row_number().over(here) == 1})

    place = F.struct(*order)
    sums = {f"__c_{n}": F.sum(f"__v_{n}") for n in total} | {f"__c_{n}": F.max(f"__v_{n}") for n in reached}
    sums |= {f"__c_{n}": F.max_by(F.struct(f"__v_{n}"), place)[f"__v_{n}"] for n in previous}
    ends = carried(rows, key, sums)
    chunks = Window.partitionBy(*key).orderBy(CHUNK)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    brought = {f"__c_{n}": F.sum(f"__c_{n}").over(earlier) for n in total}
    brought |= {f"__c_{n}": F.max(f"__c_{n}").over(earlier) for n in reached}
    brought |= {f"__c_{n}": F.lag(f"__c_{n}").over(chunks) for n in previous}
    ends = ends.select(*(F.col(k).alias(f"__k_{k}") for k in key), F.col(CHUNK).alias("__of"), *(c.alias(n) for n, c in brought.items()))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key] + [F.col(CHUNK) == F.col("__of")]
    both = local.join(F.broadcast(ends), on, "left")
    out = {}
    for n in total:
        out[n] = F.when(F.col(f"__c_{n}").isNull(), F.col(f"__own_{n}")).otherwise(F.col(f"__c_{n}") + F.coalesce(f"__own_{n}", F.lit(0)))
    for n in reached:
        out[n] = F.greatest(f"__own_{n}", f"__c_{n}")
    for n in previous:
        out[n] = F.when(F.col("__first"), F.col(f"__c_{n}")).otherwise(F.col(f"__own_{n}"))
    return both.select(*df.columns, *(c.alias(n) for n, c in out.items()))
