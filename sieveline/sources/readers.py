"""Readers: nested profiles, vectors, dictionaries, documents, submissions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.schema import profile_ddl
from sieveline.storage import stored

WORD_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"


def profiles(spark: SparkSession, path: str, signals: str = "signals") -> DataFrame:
    """One JSON record a line; blank and malformed lines are left out."""
    return spark.read.schema(profile_ddl(signals)).option("mode", "DROPMALFORMED").json(path).filter("candidate_id IS NOT NULL")


def profile_array(spark: SparkSession, path: str, signals: str = "signals") -> DataFrame:
    """One JSON array a file."""
    return spark.read.schema(profile_ddl(signals)).option("multiLine", True).json(path)


def vectors(spark: SparkSession, path: str, id_col: str = "candidate_id", vector: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("embedding"))


def query_vector(spark: SparkSession, path: str, vector: str = "embedding", encode=None, text: str = "") -> list[float]:
    """The stored vector of a job; if there is none, ``encode(text)``."""
    try:
        row = spark.read.parquet(path).select(vector).first()
    except AnalysisException:  # no such file or column
        if encode is None:
            raise
        row = None
    return [float(x) for x in (row[0] if row else encode(text))]


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """canonical, aliases, category, pos of a JSON object {canonical: {aliases, category}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<aliases: array<string>, category: string>>").alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select(F.col("e.key").alias("canonical"), F.col("e.value.aliases").alias("aliases"), F.col("e.value.category").alias("category"), "pos")


def submission(spark: SparkSession, path: str) -> DataFrame:
    """A ranked CSV, every column as text, rows of only blanks left out."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.filter(F.length(F.trim(F.concat_ws("", *df.columns))) > 0)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files; bytes that aren't UTF-8 are left out."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "").alias("text"))


def uploads(spark: SparkSession, paths: Sequence[str], suffixes: Sequence[str] = (".pdf", ".docx", ".png", ".jpg"), limit: int = 10 << 20) -> DataFrame:
    """Files of allowed kinds and sizes; of equal names (case ignored) that in the first folder."""
    every = None
    for i, p in enumerate(paths):
        one = spark.read.format("binaryFile").load(p).select("path", "length", "modificationTime").withColumn("folder", F.lit(i))
        every = one if every is None else every.unionByName(one)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    allowed = every.withColumn("name", name).filter(F.col("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & (F.col("length") <= limit))
    # Chosen by name and size alone; contents are read of what was chosen only. A read takes a list of paths, as Spark's own
    # listing of files does, so names pass through the driver and nothing else.
    first = stored(allowed.groupBy("name").agg(F.min(F.struct("folder", "path")).alias("f")).select("f.folder", "f.path"), "uploads")
    chosen = [r.path for r in first.select("path").toLocalIterator()]
    whole = spark.read.format("binaryFile").load(chosen) if chosen else spark.read.format("binaryFile").load(list(paths)).filter("1 = 0")
    return whole.withColumn("name", name).join(first, "path")


def docx_text(content: Column | str) -> Column:
    """Struct (text, complexity) of a DOCX file's paragraphs; a file that can't be read has complexity 1."""

    def one(data: bytes) -> tuple[str, float]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            return "\n".join(t.text for t in root.iter(WORD_TEXT) if t.text), 0.1
        except Exception as e:
            return f"unreadable: {type(e).__name__}", 1.0

    @F.pandas_udf("text string, complexity double")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in values], columns=["text", "complexity"])

    return run(content)


def first_path(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists; the last one if none does. Decided when the plan is built."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return paths[-1]
