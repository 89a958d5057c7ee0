"""From raw documents to token ids: five stages, each a function of (spark, docs, sf_dir).

All stages but the last return the columns of ``documents``; each works on every row that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kairoframe.llm import decontaminate, language_id, near_dup, quality, sentencepiece_codec
from kairoframe.session import cut

#: File of the vocabulary that the last stage encodes with; None takes the installed one.
VOCABULARY: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality.filter_quality(docs)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    return language_id.filter_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies of each other (five words, 0.8 or more) the one with the least id stays."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    path = VOCABULARY
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_documents(docs, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_codec", encode),
]

#: No SQL: language identification is a trained model.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
