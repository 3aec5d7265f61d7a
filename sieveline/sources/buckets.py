"""A table in hash buckets: an upsert or a deletion rewrites the buckets that it touches and no others.

Rows lie in folders by ``__bucket``, a hash of the key. ``upsert`` and ``delete`` merge the touched buckets with what comes and replace
those folders (dynamic partition overwrite: new files are complete before old ones go). ``append`` only adds a newer version of rows,
which is cheaper to write; ``read`` takes the newest version of each key, and ``compact`` rewrites the buckets that
hold more than a number of versions, so that they don't grow for ever.

Cases: of several rows of a key in one upsert the greatest stays, in the order of all columns; a null key is a key; deleting keys that aren't there
changes nothing but rewrites their buckets; an empty change touches nothing; a bucket without rows keeps a marker row, which is
never read; changes must not run at the same time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.storage import stored

BUCKET, VERSION, GONE = "__bucket", "__version", "__gone"


@dataclass(frozen=True)
class BucketTable:
    """Where a table lies, what its key is, and the columns it has. ``buckets`` can't change while the table lives."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    schema: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {VERSION} long, {GONE} boolean, {BUCKET} int").parquet(self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest version of each key; of one version the greatest row. A marker's key is no row's: it is gone and has version -1."""
        place = F.struct(VERSION, *(F.col(c) for c in self._columns()))
        kept = rows.filter(F.col(VERSION) >= 0).groupBy(BUCKET, *self.key).agg(F.max(F.struct(place.alias("p"), GONE)).alias("b"))
        return kept.filter(f"NOT b.{GONE}").select(*(F.col(f"b.p.{c}").alias(c) for c in self._columns()), BUCKET)

    def read(self) -> DataFrame:
        """The rows that are live."""
        return self._newest(self._raw()).select(*self._columns())

    def create(self, rows: DataFrame) -> None:
        """A new table of these rows; every bucket has its folder."""
        some = rows.select(*self._columns()).withColumns({VERSION: F.lit(0).cast("long"), GONE: F.lit(False), BUCKET: self._bucket()})
        every = self.spark.range(self.buckets).select(F.col("id").cast("int").alias(BUCKET))
        self._write(self._newest(some), every, "overwrite")

    def _write(self, live: DataFrame, touched: DataFrame, mode: str) -> None:
        """Live rows as version 0, with a marker in each touched bucket."""
        rows = live.withColumns({VERSION: F.lit(0).cast("long"), GONE: F.lit(False)})
        markers = touched.select(*(F.lit(None).cast(live.schema[c].dataType).alias(c) for c in self._columns()), F.lit(-1).cast("long").alias(VERSION), F.lit(True).alias(GONE), BUCKET)
        # A read of the folders that are written would lose their files half-way, so the rows are stored first.
        whole = stored(rows.select(*self._columns(), VERSION, GONE, BUCKET).unionByName(markers), "buckets")
        writer = whole.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite")
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "dynamic" else writer.option("partitionOverwriteMode", "static")).parquet(self.path)

    def _change(self, rows: DataFrame, gone: bool) -> int:
        columns = self._columns() if not gone else list(self.key)
        new = stored(rows.select(*columns).withColumn(BUCKET, self._bucket()), "changes")
        touched = new.select(BUCKET).distinct()
        numbers = [r[0] for r in touched.collect()]  # no more than there are buckets
        if not numbers:
            return 0
        old = self._newest(self._raw().filter(F.col(BUCKET).isin(numbers)))
        keys = new.select(*(F.col(k).alias(f"__k_{k}") for k in self.key)).distinct()
        left = old.join(keys, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.key], "left_anti")
        if not gone:
            left = left.unionByName(self._newest(new.withColumns({VERSION: F.lit(0).cast("long"), GONE: F.lit(False)})))
        self._write(left, self.spark.createDataFrame([(n,) for n in numbers], f"{BUCKET} int"), "dynamic")
        return len(numbers)

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in, or in place of those of their keys; how many buckets were rewritten."""
        return self._change(rows, False)

    def delete(self, keys: DataFrame) -> int:
        """Take keys out; how many buckets were rewritten."""
        return self._change(keys, True)

    def append(self, rows: DataFrame, version: int, gone: bool = False) -> None:
        """Add a newer version (above 0 and all before) of rows, or with ``gone`` of the deletion of their keys."""
        kinds = self.spark.createDataFrame([], self.schema).schema
        have = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c].dataType).alias(c) for c in self._columns()]
        new = rows.select(*have).withColumns({VERSION: F.lit(version).cast("long"), GONE: F.lit(gone), BUCKET: self._bucket()})
        new.repartition(BUCKET).write.partitionBy(BUCKET).mode("append").parquet(self.path)

    def compact(self, most: int = 4) -> int:
        """Rewrite the buckets that hold more than ``most`` versions; how many those were."""
        counts = self._raw().filter(F.col(VERSION) >= 0).groupBy(BUCKET).agg(F.countDistinct(VERSION).alias("n")).filter(F.col("n") > most)
        numbers = [r[0] for r in counts.select(BUCKET).collect()]
        if numbers:
            old = self._newest(self._raw().filter(F.col(BUCKET).isin(numbers)))
            self._write(old, self.spark.createDataFrame([(n,) for n in numbers], f"{BUCKET} int"), "dynamic")
        return len(numbers)
