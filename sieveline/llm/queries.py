"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import chat_format, exact_dedup, filter_audit, hilbert_shards, language_model, license_scan, packing, piece_codec, prefix_trie, quality, simhash, url_filters, warc
from sieveline.llm.common import table
from sieveline.llm.oracles import LICENSE, WARC
from sieveline.llm.oracles_graph import AUDIT, RULES, TRIE, URLS


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "problem")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def _digests(ids: list[int], decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(
        table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), finish=_digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user', {text}), (1L, 'assistant', {text}) AS t(turn, role, text)")
    out = chat_format.format_conversations(chat_format.records_of_rows(rows.unionByName(more)))
    turns = chat_format.read_turns(F.col("formatted"))
    learned = chat_format.learned_text(F.col("formatted"), F.col("loss_spans"))
    read = out.select("conv_id", "layout", "formatted", turns.alias("turns"), learned.alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 6, 5, conv - conv % 100)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_piece_codec": op3_piece_codec,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_model": op6_language_model,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}

ORACLES: dict[str, str] = {
    "op1_warc": WARC,
    "op10_license_scan": LICENSE,
    "op11_prefix_trie": TRIE,
    "op12_filter_audit": AUDIT,
    "op13_url_filters": URLS,
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op7_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), u AS (
            SELECT *, role || chr(10) || text || chr(10) AS said,
                   24 + length(role) + length(text) + len(regexp_extract_all(role, '\\|\n|<\||</?s>|\[/?INST\]|<</?SYS>>'))
                   + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars
            FROM t
        ), g AS (
            SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
                   string_agg(said, '' ORDER BY turn NULLS FIRST, role, text) AS every,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned
            FROM u GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
    """,
}
