"""A corpus pipeline: quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it back as the next stage's documents. All but the last return the columns
of documents.

Cases, for every stage: a null text counts as empty (the quality rules reject it); very long texts are
worked on whole; ties and repeated rows: the smallest id stays, null ids last, and of rows equal in id
and text exactly one; an empty table gives an empty result; other columns, whatever their names, are
carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import exact_dedup, packing, quality, shingle_links
from sieveline.llm.common import clear_scratch, scratch_scope, stored, table
from sieveline.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity of 0.8 or more) the document with the smallest id."""
    return shingle_links.drop_near_duplicates(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies), ("packing", packed_sequences)]

#: The trees and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch_scope() as own:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
            clear_scratch(spark, own[:-1])  # the stage's own tables and what it read; its result is the last
        return STAGES[-1][1](spark, docs, sf_dir)
