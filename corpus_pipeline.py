"""The corpus pipeline: stages that each write what they keep for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm import bpe, decontaminate, jaccard_join, language, line_dedup
from graphtables.llm.common import Scratch, table


#: Languages that the corpus is to have.
LANGUAGES = ("de", "en", "es", "fr")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, are predicted to be in none of LANGUAGES, or whose best language is less likely than not."""
    return language.known_language(spark, docs, LANGUAGES, least=0.5)


def without_late_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents of which nothing else is left; n_chars follows the text."""
    out = line_dedup.without_lines(docs, line_dedup.late_lines(spark, docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, the one with the smallest id stays."""
    return jaccard_join.one_of_each(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", known_language),
    ("lines", without_late_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("tokens", encoded),
]
#: Models, rules for equal lines and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tmp:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = tmp.table(stage(spark, docs, sf_dir), name)
        return tmp.keep(STAGES[-1][1](spark, docs, sf_dir))
