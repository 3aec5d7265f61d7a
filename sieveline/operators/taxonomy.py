"""Names brought to a taxonomy's canonical ones, and mentions merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.names import CUTOFF, closest_names, subset_names
from sieveline.storage import stored

# Weights of the sections a mention stands in.
SECTION_WEIGHTS = {"certification": 1.0, "experience": 0.8, "projects": 0.6, "education": 0.5, "skills": 0.2}
_SECTIONS = {
    "certification": "certification", "certifications": "certification", "project": "projects", "projects": "projects",
    "experience": "experience", "work_experience": "experience", "employment": "experience", "education": "education", "academic": "education",
}


def aliases(taxonomy: DataFrame) -> DataFrame:
    """alias, canonical, pos from rows (canonical, aliases, category, pos); later names win."""
    every = taxonomy.select("canonical", "pos", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return every.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("canonical", "pos").alias("canonical"), F.max("pos").alias("pos"))


def normalise_names(names: DataFrame, known: DataFrame, column: str = "name", cutoff: float = CUTOFF) -> DataFrame:
    """Adds canonical and method: exact, then closest by ratio, then token subset, else none.

    known: alias, canonical, pos, an alias once. Only distinct names that a step left over reach the next; each step is a join, so
    neither side has a largest size.
    """
    key = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    known = stored(known.select("alias", "canonical", "pos"), "known-names")
    entries = known.select(F.col("alias").alias("text"), "pos")
    distinct = names.select(key.alias("__key")).distinct()
    exact = stored(distinct.join(known.select(F.col("alias").alias("__key"), F.col("canonical").alias("__exact")), "__key", "left"), "exact-names")
    left = exact.filter("__exact IS NULL AND __key <> ''").select(F.col("__key").alias("text"))
    near = stored(closest_names(left, entries.select("text"), cutoff), "near-names")
    rest = left.join(near.select(F.col("name").alias("text")), "text", "left_anti")
    subset = subset_names(rest, entries)
    of = known.select(F.col("alias").alias("entry"), "canonical")
    found = near.select("name", "entry", F.lit("fuzzy").alias("method")).unionByName(subset.select("name", "entry", F.lit("subset").alias("method"))).join(of, "entry")
    found = exact.join(found.select(F.col("name").alias("__key"), F.col("canonical").alias("__near"), "method"), "__key", "left")
    method = F.when(F.col("__exact").isNotNull(), "exact").otherwise(F.coalesce("method", F.lit("none")))
    found = found.select("__key", F.coalesce("__exact", "__near").alias("canonical"), method.alias("method"))
    return names.withColumn("__key", key).join(found, "__key", "left").drop("__key")


def section(c: Column) -> Column:
    cleaned, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("skills")
    for name, to in _SECTIONS.items():
        out = F.when(cleaned == name, to).otherwise(out)
    return out


def confidence(source: Column, context: Column, negated: Column) -> Column:
    text = F.lower(F.coalesce(context, F.lit("")))
    weight = F.lit(SECTION_WEIGHTS["skills"])
    for name, w in SECTION_WEIGHTS.items():
        weight = F.when(section(source) == name, w).otherwise(weight)
    weak = F.contains(text, F.lit("familiar with")) | F.contains(text, F.lit("basic knowledge"))
    return F.when(F.coalesce(negated, F.lit(False)), 0.0).when(weak, 0.3).otherwise(weight)


def noisy_or(hint: Column, digits: int = 2) -> Column:
    """Aggregate: the chance that one of a group's independent hints is right.

    The product of a group is order-free, so no list of hints is built: logs would fail where a hint is certain, so certain
    hints are counted apart.
    """
    doubt = F.when(hint < 1, F.log(1 - hint))
    return F.round(F.when(F.count_if(hint >= 1) > 0, 1.0).otherwise(1 - F.exp(F.coalesce(F.sum(doubt), F.lit(0.0)))) + 1e-12, digits)


def merge_mentions(mentions: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key and canonical name.

    mentions: key, canonical, name, source_section, context, negated, pos.
    """
    c = confidence(F.col("source_section"), F.col("context"), F.col("negated"))
    rows = mentions.withColumn("confidence", c).withColumn("__section", section(F.col("source_section")))
    merged = rows.groupBy(*key, F.lower("canonical").alias("canonical")).agg(
        F.count("*").alias("mentions"), F.count_if("negated").alias("negated_mentions"), F.max_by("name", F.struct("confidence", -F.col("pos"))).alias("name"),
        F.array_join(F.sort_array(F.collect_set("__section")), ",").alias("sections"),
        noisy_or(F.col("confidence")).alias("confidence"),
    )
    return merged.withColumn("eligible", F.col("negated_mentions") < F.col("mentions"))
