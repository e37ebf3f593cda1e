"""A training-data pipeline over ``documents``: STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from riskgrain.llm import bpe, decontaminate, jaccard, language, line_dedup
from riskgrain.session import scratch_path, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is found with some certainty; missing languages are filled in."""
    return language.accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a later one repeats."""
    kept = line_dedup.deduplicate_lines(docs, counts=tuple(line_dedup.fresh(docs, "_lines", "_dropped")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return jaccard.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or not."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: A trained model decides the first stage, so no SQL gives these rows; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
