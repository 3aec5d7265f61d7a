"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.storage import clear_scratch, scratch_path, scratch_paths, scratch_scope, shared_dir, stored

__all__ = ["clear_scratch", "scratch_path", "scratch_paths", "scratch_scope", "shared_dir", "stored"]

#: White space that separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: So many keys are broadcast at most; more are joined by a shuffle.
FEW = 500_000

#: Rows of an Arrow batch, unless the session says otherwise: whole texts are longer than the rows that Spark's own number is meant for.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500")

_state: dict = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, and have texts handed to them in smaller batches."""
    sc = spark.sparkContext
    name, default, rows = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    if _state.get("shipped") == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="sieveline-py-")) / "sieveline_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(to))
    _state["shipped"] = sc.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever else the text holds."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_rows(docs: DataFrame, verdicts: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs`` only.

    verdicts: rows (the names of ``keys``, kept) for at least all rows that go and all repeated rows;
    keys: how to compute those names from a row of ``docs``. Rows of ``docs`` that agree on all keys
    count as repeated: one stays if any is kept. Only rows that verdicts name can go, so where those
    are ``FEW`` the texts of the others aren't shuffled.
    """
    names = list(keys)
    each = verdicts.groupBy(*names).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1")
    each = stored(each.select(*(F.col(k).alias(f"__v_{k}") for k in names), F.col("kept").alias("__repeated")), "verdicts")
    n, repeated = each.agg(F.count("*"), F.count_if("__repeated")).first()
    right = F.broadcast(each) if n <= FEW else each
    marked = docs.select("*", *(v.alias(f"__k_{k}") for k, v in keys.items()))
    on = [F.col(f"__k_{k}").eqNullSafe(F.col(f"__v_{k}")) for k in names]
    own = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.join(right, on, "left_anti").select(*own)
    if not repeated:
        return alone
    one = marked.join(right.filter("__repeated"), on, "left_semi").dropDuplicates([f"__k_{k}" for k in names]).select(*own)
    return alone.unionByName(one)
