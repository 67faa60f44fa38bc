"""A training corpus from raw documents: five stages, each a written table that the next one reads.

Every stage but the last returns the columns of its input; rows that a stage rejects are gone for
the next one.  Null texts have no language, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagcall.llm import decontaminate, language, mixing, near_dedup, token_store
from tagcall.llm._spark import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language.drop_unidentified(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or its paraphrase go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to the target weights of their sources."""
    return mixing.repeat_to_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's directory, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.read_store(token_store.write_store(docs, token_store.tokenizer_path(), "pipeline-tokens"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express neither the models nor the rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
