"""Shards cut from a Hilbert curve over metadata, for pruning files by several dimensions at once.

Each dimension is cut at its quantiles into up to 2**bits steps (numbers at approximate ones, strings
at exact ones of their counted values, compared whole); the steps of all dimensions name a cell, and cells are visited along a Hilbert curve, so rows that are near on the curve are near in
every dimension. Rows are sorted by curve index over the whole cluster (a range partitioning whose
last key is unique, so a cell with a third of all rows is split too) and cut into runs of equal
length: law ``rows``, counts differ by one at most. Everything is DataFrame expressions.

Cases: null values of a dimension come first; a null text has size 1 and the checksum of no bytes;
repeated rows each take a slot; an empty table gives an empty result; columns that aren't dimensions
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stored, text_or_empty

BITS, SHARDS = 5, 8


def with_hilbert_index(df: DataFrame, steps: list[Column], name: str = "curve", bits: int = BITS) -> DataFrame:
    """Adds the position on the Hilbert curve of the cell with these coordinates (integers below 2**bits).

    Each stage is a column of its own: what a lambda or several terms use is computed once a row.
    """
    n = len(steps)

    def rotate(a: Column, s: Column) -> Column:
        """Undo the excess rotations of one axis at one bit: flip the first axis' lower bits or swap them with this axis'."""
        q, this, head = s["q"], F.get(a, s["axis"]), F.get(a, F.lit(0))
        flips, swap = this.bitwiseAND(q) != 0, head.bitwiseXOR(this).bitwiseAND(q - 1)
        change = F.when(flips, q - 1).otherwise(swap)
        first = F.when(flips | (s["axis"] != 0), head.bitwiseXOR(change)).otherwise(head)
        return F.transform(a, lambda v, k: F.when(k == 0, first).when((k == s["axis"]) & ~flips, v.bitwiseXOR(swap)).otherwise(v))

    turns = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)))
    out = df.withColumn("__x", F.array(*(s.cast("int") for s in steps)))
    out = out.withColumn("__x", F.aggregate(turns, F.col("__x"), rotate))
    # Gray code along the axes, then the parity of the last axis' bits above each bit.
    gray = [F.get("__x", F.lit(0))]
    for i in range(1, n):
        gray.append(gray[-1].bitwiseXOR(F.get("__x", F.lit(i))))
    out = out.withColumn("__g", F.array(*gray))
    last = F.get("__g", F.lit(n - 1))
    for b in range(bits - 1, 0, -1):
        term = F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))
        parity = term if b == bits - 1 else parity.bitwiseXOR(term)
    out = out.withColumn("__t", parity)
    terms = [
        F.when(F.get("__g", F.lit(i)).bitwiseXOR(F.col("__t")).bitwiseAND(F.lit(1 << b)) != 0, F.lit(1 << (b * n + n - 1 - i)).cast("long")).otherwise(F.lit(0).cast("long"))
        for b in range(bits)
        for i in range(n)
    ]
    return out.withColumn(name, sum(terms[1:], terms[0])).drop("__x", "__g", "__t")


def _with_offset(ordered: DataFrame, by: Column) -> DataFrame:
    """A stored, sorted table with ``__before``: the sum of ``by`` over all rows before, by the sums of its partitions.

    ordered: has ``__at``, the monotonically increasing ids given when it was sorted.
    """
    rows = ordered.withColumn("__part", F.shiftrightunsigned("__at", 33)).withColumn("__by", by.cast("long"))
    # One row for each partition of the sorted table: bounded by the number of shuffle partitions.
    sums = rows.groupBy("__part").agg(F.sum("__by").alias("__sum"))
    starts = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__start"))
    within = F.sum("__by").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__by")
    return rows.join(F.broadcast(starts), "__part").withColumn("__before", F.col("__start") + within).drop("__part", "__by", "__start")


def string_cuts(df: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The values at the quantiles i / 2**bits of a string column, of which there are less than 2**bits."""
    counts = df.select(F.col(f"`{column}`").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    ordered = stored(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("__at", F.monotonically_increasing_id()), "values")
    total = ordered.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    position = lambda c: F.floor(c * F.lit(1 << bits) / F.lit(total))
    placed = _with_offset(ordered, F.col("n")).filter(position(F.col("__before") - 1) < position(F.col("__before") + F.col("n") - 1))
    return sorted((r.value for r in placed.select("value").collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))[: (1 << bits) - 1]


def hilbert_shards(docs: DataFrame, dimensions: dict[str, Column], keep: dict[str, Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The columns ``keep`` of each row with its curve index, shard and slot.

    dimensions: name and column of each, strings or numbers; keep: what to carry through.
    """
    narrow = docs.select(*(v.alias(k) for k, v in keep.items()), *(v.alias(f"__d_{k}") for k, v in dimensions.items()))
    strings = {k for k in dimensions if dict(narrow.dtypes)[f"__d_{k}"] == "string"}
    names = list(dimensions)
    narrow = narrow.withColumns({f"__d_{k}": F.col(f"__d_{k}").cast("double") for k in names if k not in strings})
    narrow = stored(narrow.withColumn("__row", F.monotonically_increasing_id()), "metadata")
    quantiles = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = narrow.agg(F.count("*").alias("n"), *(F.percentile_approx(f"__d_{k}", quantiles, 10_000).alias(k) for k in names if k not in strings)).first()
    n = found["n"]
    every = {k: string_cuts(narrow, f"__d_{k}", bits) if k in strings else sorted(set(found[k] or [])) for k in names}

    def step(k: str) -> Column:
        cuts = every[k]
        # no more than 2**bits - 1 values, so the list stays small
        return F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(f"__d_{k}"))) if cuts else F.lit(0)

    steps = [F.coalesce(F.when(F.col(f"__d_{k}").isNull(), 0).otherwise(step(k)), F.lit(0)) for k in names]
    curve = with_hilbert_index(narrow, steps, "curve", bits).drop(*(f"__d_{k}" for k in names))
    ordered = curve.repartitionByRange("curve", "__row").sortWithinPartitions("curve", "__row")
    ordered = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), "curve")
    placed = _with_offset(ordered, F.lit(1)).withColumnRenamed("__before", "at")
    shard = F.expr(f"at * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(*(F.col(k) for k in keep), "curve", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Documents by language, source and size."""
    size = F.octet_length(text_or_empty()).cast("long") + 1
    dims = {c: F.col(c) for c in ("lang", "source") if c in docs.columns} | {"size": F.log2(size.cast("double"))}
    keep = {"doc_id": F.col("doc_id").cast("long"), "size": size, "text_crc32": F.crc32(F.encode(text_or_empty(), "utf-8"))}
    return hilbert_shards(docs, dims, keep, shards, bits)


def write_shards(docs: DataFrame, placed: DataFrame, keys: list[str], path: str) -> None:
    """Write the documents as one folder for each shard, sorted along the curve; a shard may be several files.

    keys: columns that name a row of both, each once.
    """
    placed = placed.select(*keys, "shard", "slot")
    whole = docs.join(placed, keys).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    whole.write.partitionBy("shard").parquet(path)
