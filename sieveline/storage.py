"""Intermediate tables in the folder that driver and executors share.

``stored`` writes a table and reads it back: that cuts lineage, survives lost executors, and lets Spark
delete the shuffle files of the step at once. Spark removes the tables themselves only when told:
``clear_scratch`` removes those written so far, ``scratch_scope`` collects the paths of one run.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_all: list[str] = []
#: Of the run that is open in this thread; threads don't see each other's.
_scope: ContextVar[list[str]] = ContextVar("scratch", default=_all)
#: While a table is written: its shuffle files go afterwards, and small partitions become few files of the advisory size.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset on a single machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own.setdefault("dir", Path(tempfile.mkdtemp(prefix="sieveline-")).as_uri())).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/sieveline/{name}-{uuid.uuid4().hex}"
    _scope.get().append(path)
    return path


def scratch_paths() -> list[str]:
    """What was written so far in the open scope and not cleared."""
    return list(_scope.get())


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The paths written inside, as a list that grows; what is left of them goes to the outer scope."""
    outer, mine = _scope.get(), []
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        outer.extend(mine)


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these tables, or all of the open scope. Call it once results that read them are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in scratch_paths() if paths is None else list(paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        for known in (_scope.get(), _all):
            if path in known:
                known.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files behind it go when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
