"""Whole rankings: retrieval, features, scores, order, reasons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import specs
from sieveline.functions.numbers import clip, weighted
from sieveline.functions.text import english_stop_words
from sieveline.operators import explain, families, features, pool, retrieval
from sieveline.operators.compare import showcase_relevance
from sieveline.operators.ranking import display_score, exact_percentile, rank_top, top, with_min_max
from sieveline.schema import JobSpec
from sieveline.storage import stored

DIGITS = 6
MOST_RETRIEVED = 100_000


def relative_ranking(profiles: DataFrame, vectors: DataFrame, query_vector: Sequence[float], query: str, spec: JobSpec, weights: Mapping[str, float] = specs.RELATIVE_WEIGHTS, k: int = 100, retrieve: int = 6000, id_col: str = "candidate_id", stop_words: Iterable[str] | None = None) -> DataFrame:
    """Fused retrieval over the pool, features over what it retrieves, top k with reasons.

    vectors: id (as in ``profiles``), embedding. The costly features are computed for ``retrieve``
    profiles only; those come back by a join whose right side has at most that many rows, broadcast up to ``MOST_RETRIEVED``.
    stop_words: English ones if not given.
    """
    stop = english_stop_words() if stop_words is None else tuple(stop_words)
    texts = features.with_texts(profiles)
    lexical = retrieval.lexical_scores(texts.select(id_col, features.lexical_document().alias("__doc")), id_col, "__doc", query, stop_words=stop)
    dense = retrieval.dense_scores(vectors, "id", "embedding", query_vector)
    fused = retrieval.fuse(dense, lexical, retrieve, share_of=0.99)
    fused = stored(with_min_max(fused, "rrf", "retrieval_fusion", few=True), "fused")
    best = fused.select(F.col("id").alias("__id"), "cosine", "share", "retrieval_fusion")
    kept = texts.join(F.broadcast(best) if retrieve <= MOST_RETRIEVED else best, F.col(id_col) == F.col("__id"))
    wide = features.integrity(features.relative_features(kept, spec), spec.reference_date)
    real = wide.withColumn("semantic_sim", clip(F.col("cosine"))).withColumn("bm25_score", F.col("share"))
    scored = real.withColumn("raw_score", F.round(weighted(weights) - 100.0 * F.col("honeypot"), DIGITS + 2))
    best = with_min_max(top(scored, k, [("raw_score", True), (id_col, False)]), "raw_score", "__unit", few=True)
    # the written score is rounded, so the order is taken again on what will be written
    best = rank_top(best.withColumn("score", F.round("__unit", 4)).drop("__unit"), [("score", True), (id_col, False)])
    return best.withColumn("reasoning", explain.reasoning(spec))


def frozen_ranking(profiles: DataFrame, spec: JobSpec, roles=None, skills=None, k: int = 100, whole_words: bool = True, id_col: str = "candidate_id") -> DataFrame:
    """The frozen family ranking: the title is that of the first spell."""
    texts = features.with_texts(profiles)
    texts = texts.withColumn("current_title", F.lower(F.coalesce(F.get("__career", F.lit(0))["title"], F.lit("")))).withColumn("quality_score", features.quality_score())
    scored = families.frozen_score(families.family_features(texts, spec, roles, skills, whole_words))
    scored = scored.withColumn("final_score", F.round("final_score", DIGITS))
    return rank_top(top(scored, k, [("final_score", True), (id_col, False)]), [("final_score", True), (id_col, False)])


def scaled_ranking(profiles: DataFrame, spec: JobSpec, roles=None, skills=None, k: int = 100, id_col: str = "candidate_id") -> DataFrame:
    """The demo's family ranking with transferable skills."""
    texts = features.with_texts(profiles).withColumn("quality_score", features.quality_score())
    wide = families.family_features(texts, spec, roles, skills, strict=False)
    bonus, risk, evidence = families.transferable(F.col("skills_text"), spec.req_skills)
    wide = wide.withColumn("skill_affinity", F.col("skill_affinity") + bonus).withColumn("transfer_risk", risk).withColumn("transfer_evidence", evidence)
    scored = families.scaled_score(wide).withColumn("final_score", F.round("final_score", DIGITS))
    return rank_top(top(scored, k, [("final_score", True), (id_col, False)]), [("final_score", True), (id_col, False)])


def pool_ranking(profiles: DataFrame, vectors: DataFrame, query_vector: Sequence[float], query: str, spec: JobSpec, predict=None, k: int = 100, retrieve: int = 5000, anti: Mapping[str, float] = specs.ANTI_SKILLS, id_col: str = "candidate_id", stop_words: Iterable[str] | None = None) -> DataFrame:
    """The pool ranking: the best by vector and the best by words, features with both scores, a model or the linear score, top k.

    Features are computed for what either retrieval kept, twice ``retrieve`` at most. vectors: id (as in ``profiles``), embedding; predict: see
    ``pool.model_score``.
    """
    stop = english_stop_words() if stop_words is None else tuple(stop_words)
    texts = features.with_texts(profiles)
    lexical = stored(retrieval.lexical_scores(texts.select(id_col, features.lexical_document().alias("__doc")), id_col, "__doc", query, stop_words=stop), "lexical")
    dense = stored(retrieval.dense_scores(vectors, "id", "embedding", query_vector), "dense")
    both = retrieval.union_of_tops(dense, lexical, retrieve)
    at = exact_percentile(lexical, "lexical", 0.99).scalar()
    scores = both.join(dense, "id", "left").join(lexical, "id", "left").select("id", "cosine", (F.col("lexical") / (at + 1e-9)).alias("share"))
    scores = stored(scores, "pool-scores")
    chosen = scores.select(F.col("id").alias("__chosen"))
    kept = texts.join(F.broadcast(chosen) if 2 * retrieve <= MOST_RETRIEVED else chosen, F.col(id_col) == F.col("__chosen"), "left_semi")
    wide = pool.with_real_scores(pool.pool_features(kept, spec, anti=anti), scores, id_col)
    scored = pool.model_score(wide, predict).withColumn("pool_score", F.round("pool_score", DIGITS))
    return pool.packed(scored, k)


def showcase_ranking(profiles: DataFrame, k: int = 40, id_col: str = "candidate_id") -> DataFrame:
    """Relevance by hits, then a display score by place."""
    scored = features.with_texts(profiles).withColumn("relevance", F.round(showcase_relevance(), DIGITS))
    ranked = rank_top(top(scored, k, [("relevance", True), (id_col, False)]), [("relevance", True), (id_col, False)])
    return ranked.withColumn("final_score", display_score(F.col("rank") - 1))
