"""The operators over whole tables, as the driver calls them: (spark, folder) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    alignment,
    chat,
    count_rtree,
    ego_join,
    importance,
    language,
    mixing,
    packing,
    pii,
    quality,
    secrets,
    url_rules,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_counts(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    is_held_out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    model = language.learn_languages(docs.where(~is_held_out))
    return language.identify_languages(docs, model).select(
        "doc_id", is_held_out.alias("held_out"), "lang_pred", "score"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"), carried=["doc_id"])
    return judged.select(
        "document.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "own_words",
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = count_rtree.near_documents(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_shingles", "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    settings = importance.ResampleSettings()
    ranks = importance.ranked(importance.scored(docs, target, settings), settings)
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_turns(_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_secret_scan,
        op3_embedding_near_dedup,
        op4_warc_round_trip,
        op5_personal_data,
        op6_language_id,
        op7_quality_rules,
        op8_jaccard_join,
        op9_best_fit_packing,
        op10_url_filter,
        op11_token_alignment,
        op12_importance_resampling,
        op13_chat_format,
    )
}
