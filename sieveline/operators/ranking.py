"""Ranks, fusion, normalisation and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import stored

#: Rows that are broadcast at most.
FEW = 500_000


def global_rank(df: DataFrame, by: list[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """Adds the 0-based position of every row in the order ``by``: columns, each with True for descending.

    The order must be total. An unpartitioned window would sort the whole table in one task. Here
    rows are range-partitioned and sorted, each partition is counted, and the counts of the
    partitions before (one row a partition, so small enough to broadcast) are added.
    """
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), "rank")
    part = F.shiftrightunsigned("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    starts = counts.select("__part", before.alias("__before"))
    placed = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(rank, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")


def top(df: DataFrame, k: int, by: list[tuple[str, bool]]) -> DataFrame:
    """The first k rows: each task keeps its own k, so nothing is sorted globally."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by)).limit(k)


def rank_top(df: DataFrame, by: list[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """1-based ranks of a table that ``top`` has already made small."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by]
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank(*ranks: Column | str, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over 0-based ranks."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + 1.0 / (k + (F.col(r) if isinstance(r, str) else r))
    return out


def with_min_max(df: DataFrame, column: str, name: str, flat: float | None = None, few: bool = False) -> DataFrame:
    """Scale to 0..1 by the column's least and largest value.

    flat: the value where all are equal; without it 1e-9 is added to the width. few: the table is one that
    ``top`` has made small, so a window over it takes one pass; otherwise the ends are aggregated first.
    """
    width = F.col("__high") - F.col("__low")
    scaled = (F.col(column) - F.col("__low")) / (width + 1e-9) if flat is None else F.when(width == 0, F.lit(flat)).otherwise((F.col(column) - F.col("__low")) / F.when(width != 0, width))
    if few:
        every = Window.partitionBy()
        return df.withColumn("__low", F.min(column).over(every)).withColumn("__high", F.max(column).over(every)).withColumn(name, scaled).drop("__low", "__high")
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("__low", "__high")


def exact_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the percentile with linear interpolation, from the two values around its place in a distributed sort."""
    values = df.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    ranked = global_rank(values, [("value", False)], "at")
    n = ranked.agg((F.count("*") - 1).alias("last"))
    near = ranked.crossJoin(F.broadcast(n.select((F.col("last") * F.lit(q)).alias("place")))).filter(F.col("at").isin(F.floor("place"), F.ceil("place")))
    low, high, share = F.min("value"), F.max("value"), F.max(F.col("place") - F.floor("place"))
    return near.agg((low + (high - low) * share).alias("percentile"))


def percentile_by_rank(ranked: DataFrame, column: str, rank: str, q: float) -> Column:
    """The percentile with linear interpolation, as a scalar: from the two values around its place by 0-based descending ranks without nulls."""
    last = ranked.agg(F.count("*") - 1).scalar().cast("double")
    place = last * q
    near = ranked.filter(F.col(rank).isin(last - F.floor(place), last - F.ceil(place)))
    low, high = F.min(column), F.max(column)
    return near.agg(low + (high - low) * F.max(place - F.floor(place))).scalar()


def grouped_percentile(df: DataFrame, keys: list[str], column: str, q: float, buckets: int = 1024, few: int = 4096) -> DataFrame:
    """keys, percentile, n: the percentile with linear interpolation of each group, however large a group is.

    The one or two wanted places of a group are narrowed to a range of values, all groups at once: a histogram of the range
    tells which of its buckets holds the place, and that bucket's least and largest value are the next range, until
    at most ``few`` rows (or one value) are left, which are sorted. Rows stay where they are; a round shuffles at most
    ``buckets`` counts for each place. Nulls and NaN don't count; infinities are values.
    """
    values = stored(df.select(*keys, F.col(column).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)"), "values")
    sizes = stored(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "sizes")
    at = F.lit(q) * (F.col("n") - 1)
    places = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))
    wanted = stored(sizes.select(*keys, places.alias("place"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "wanted")

    def rows(open_: DataFrame) -> DataFrame:
        named = open_.select(*(F.col(k).alias(f"__{k}") for k in keys), "place", "low", "high", "before", "inside")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return values.join(F.broadcast(named) if named.count() <= FEW else named, same).filter(F.col("value").between(F.col("low"), F.col("high")))

    while True:
        is_open = (F.col("inside") > few) & (F.col("low") < F.col("high"))
        if wanted.filter(is_open).isEmpty():
            break
        inf = F.lit(float("inf"))
        width = F.col("high") / 2 - F.col("low") / 2
        bucket = F.least(F.floor((F.col("value") / 2 - F.col("low") / 2) / width * buckets), F.lit(buckets - 1))
        # Infinities are set apart first; what is left has a width.
        bucket = F.when(F.col("value") == -inf, 0).when(F.col("value") == inf, buckets - 1).when(width == inf, buckets // 2).otherwise(bucket)
        each = rows(wanted.filter(is_open)).groupBy(*keys, "place", "before", bucket.alias("bucket")).agg(F.count("*").alias("inside"), F.min("value").alias("low"), F.max("value").alias("high"))
        earlier = Window.partitionBy(*keys, "place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("before", F.col("before") + F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
        picked = each.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("inside")))
        wanted = stored(wanted.filter(~is_open).unionByName(picked.select(*wanted.columns)), "wanted")
    sorted_ = Window.partitionBy(*keys, "place").orderBy("value")
    last = rows(wanted.filter("low < high")).withColumn("__at", F.col("before") + F.row_number().over(sorted_) - 1).filter(F.col("__at") == F.col("place"))
    found = wanted.filter("low = high").select(*keys, F.col("low").alias("value")).unionByName(last.select(*keys, "value"))
    found = found.groupBy(*keys).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    named = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "__low", "__high")
    both = sizes.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    between = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("__low") + (F.col("__high") - F.col("__low")) * (at - F.floor(at)))
    return both.select(*keys, between.alias("percentile"), "n")


def with_share_of_percentile(df: DataFrame, column: str, name: str, q: float = 0.99) -> DataFrame:
    """Divide by the exact percentile of the whole column (plus 1e-9) and clip to 0..1."""
    df = stored(df, "percentile-of")
    at = exact_percentile(df, column, q).withColumnRenamed("percentile", "__p")
    return df.crossJoin(F.broadcast(at)).withColumn(name, F.least(F.greatest(F.col(column) / (F.col("__p") + 1e-9), F.lit(0.0)), F.lit(1.0))).drop("__p")


def latest(df: DataFrame, key: list[str], by: list[tuple[str, bool]]) -> DataFrame:
    """The first row of each key in the order ``by``."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def display_score(rank0: Column) -> Column:
    """A score for show by 0-based rank: three straight pieces."""
    r = rank0.cast("double")
    return F.round(F.when(rank0 < 14, 86 - r).when(rank0 < 24, 58 - 2.4 * (r - 14)).otherwise(F.greatest(F.lit(6.0), 24 - 1.4 * (r - 24))), 1)
