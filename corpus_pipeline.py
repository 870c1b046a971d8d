"""From raw documents to distinct segmentations of what is left, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, exact_dedup, language, sentencepiece_sampling, simhash
from quillspark.llm.runtime import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the ones that language identification finds ambiguous, or has no letters to judge by."""
    return language.keep_identified(docs, language.train(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of all that have the same bytes."""
    return exact_dedup.drop_exact_duplicates(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item, in its own words or with other values."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document left, each checked by decoding it."""
    return sentencepiece_sampling.sampled_segmentations(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", no_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("sentencepiece_sampling", segmentations),
]

#: Fingerprints, fitted classifiers and sampled paths are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each gives is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
