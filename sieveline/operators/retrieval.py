"""Retrieval by vectors and by words, and how both are put together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vectors import cosine
from sieveline.operators.ranking import global_rank, percentile_by_rank, reciprocal_rank, top
from sieveline.operators.termcounts import each_term, term_counts
from sieveline.storage import stored


def dense_scores(vectors: DataFrame, id_col: str, vector: str, query: Sequence[float], digits: int = 10) -> DataFrame:
    """id, cosine with the query vector; rounded so that equal vectors tie whatever the order of sums."""
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector), query), digits).alias("cosine"))


def lexical_scores(docs: DataFrame, id_col: str, text: str, query: str, max_features: int = 5000, stop_words: Iterable[str] = (), digits: int = 10) -> DataFrame:
    """id, lexical: TF-IDF cosine with a query that counts as one more document; a row for each row of ``docs``.

    Smoothed idf is ln((1 + n) / (1 + df)) + 1. Only the ``max_features`` terms of largest
    collection frequency count (ties by term): a table of that size, so it is broadcast. Terms are counted inside
    the row; what is shuffled is partial counts by term, and then two sums for each document.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.lit(False).alias("is_query"), F.col(text).alias("__text"))
    asked = spark.range(1).select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), F.lit(True).alias("is_query"), F.lit(query).alias("__text"))
    # Counts feed the vocabulary, the query's weights and all documents' weights, so they are stored once.
    counted = stored(term_counts(own.unionByName(asked), "__text").withColumn("row", F.monotonically_increasing_id()), "term-counts")
    terms = each_term(counted, "is_query")
    stop = sorted(set(stop_words))
    if stop:
        terms = terms.filter(~F.col("term").isin(stop))
    vocabulary = terms.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df"), F.sum(F.when(F.col("is_query"), F.col("tf"))).alias("asked"))
    vocabulary = vocabulary.orderBy(F.col("ctf").desc(), "term").limit(max_features)
    n = counted.agg(F.count("*")).scalar()
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    vocabulary = stored(vocabulary.select("term", idf.alias("idf"), (F.coalesce("asked", F.lit(0)) * idf).alias("q")), "vocabulary")
    q_norm = vocabulary.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).scalar()
    each = counted.filter("NOT is_query").select("id", "row", F.explode_outer(F.arrays_zip("terms", "counts")).alias("t")).select("id", "row", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    w = F.col("tf") * F.col("idf")
    # one pass over a document's weights gives its length and its product with the query
    sums = each.join(F.broadcast(vocabulary), "term", "left").groupBy("row", "id").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * F.col("q")).alias("dot"))
    score = F.round(F.try_divide(F.col("dot"), F.col("norm") * q_norm), digits)
    return sums.select("id", F.coalesce(score, F.lit(0.0)).alias("lexical"))


def fuse(dense: DataFrame, lexical: DataFrame, retrieve: int = 6000, k: int = 60, share_of: float | None = None) -> DataFrame:
    """id, cosine, lexical, both 0-based ranks and their fusion, for the ``retrieve`` best by fusion.

    Ids come from the lexical side; one without a vector has cosine 0 and ranks after all vectors. share_of: adds share, the
    lexical score as a share of that percentile of all scores, clipped to 0..1; the percentile is read off the ranks.
    """
    by_vector = global_rank(stored(dense, "dense"), [("cosine", True), ("id", False)], "rank_dense")
    by_words = stored(global_rank(stored(lexical, "lexical"), [("lexical", True), ("id", False)], "rank_lexical"), "by-words")
    n = by_words.agg(F.count("*")).scalar()
    if share_of is not None:
        at = percentile_by_rank(by_words, "lexical", "rank_lexical", share_of)
        by_words = by_words.withColumn("share", F.least(F.greatest(F.col("lexical") / (at + 1e-9), F.lit(0.0)), F.lit(1.0)))
    both = by_words.join(by_vector, "id", "left")
    more = [c for c in by_words.columns if c not in ("id", "lexical", "rank_lexical")]
    both = both.select(
        "id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "lexical", *more, F.coalesce(F.col("rank_dense"), n).alias("rank_dense"), "rank_lexical"
    ).withColumn("rrf", F.round(reciprocal_rank("rank_dense", "rank_lexical", k=k), 12))
    return top(both, retrieve, [("rrf", True), ("id", False)])


def encoded(df: DataFrame, id_col: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 2000, half: bool = True) -> DataFrame:
    """id, embedding by a model that is passed in, in batches of texts; half: values as half precision keeps them."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), dtype=np.float16 if half else np.float32).astype(np.float32)
                flat = pa.array(vectors.ravel())
                ends = pa.array(np.arange(0, len(flat) + 1, vectors.shape[1] if len(vectors) else 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "embedding"])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def reranked(pairs: DataFrame, query: str, text: str, predict: Callable[[list[str], list[str]], np.ndarray], id_col: str, k: int = 30) -> DataFrame:
    """The k rows that a pair model, passed in, scores highest with the query; ties by id. Meant for rows that retrieval kept."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict([query] * len(texts), texts.fillna("").tolist()), dtype=np.float64))

    scored = pairs.withColumn("pair_score", score(F.col(text)))
    return top(scored, k, [("pair_score", True), (id_col, False)])


def union_of_tops(dense: DataFrame, lexical: DataFrame, k: int = 5000) -> DataFrame:
    """Ids among the k best by vector or the k best by words."""
    a = top(dense, k, [("cosine", True), ("id", False)]).select("id")
    return a.union(top(lexical, k, [("lexical", True), ("id", False)]).select("id")).distinct()
