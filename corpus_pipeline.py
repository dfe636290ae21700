"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir), docs being what the stage before
returned, and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import count_rtree, mixing, packing, pii, quality
from plumbline.llm.tables import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality.quality_rules(docs).where("kept").select("document.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return count_rtree.first_of_each_class(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text."""
    redacted = pii.redact_documents(docs)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        redacted = redacted.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return redacted.select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them, in its order."""
    return mixing.mixed_documents(docs).select("document.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their texts, in bins of the permitted lengths."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_dedup", dedup_stage),
    ("redact_personal_data", pii_stage),
    ("mix_sources", mix_stage),
    ("best_fit_packing", pack_stage),
]

# Span classifiers and packing have no SQL form; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
