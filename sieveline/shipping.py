"""Python functions of this package run in workers that may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_state: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if _state.get("shipped") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="sieveline-py-")) / "sieveline_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(to))
    _state["shipped"] = sc.applicationId
