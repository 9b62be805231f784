"""A training-data pipeline over `documents`: each stage is one corpus operator, written and read again by its caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import exact_dedup, language, packing, quality, simhash
from stackroom.llm.common import table, written
from stackroom.llm.queries import word_tokenizer

#: A document whose profile distance is nearer the worst than this is no language that was learned.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled languages, drop documents of no known language. Columns of docs."""
    found = language.identify(docs, language.learn(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of low quality or toxic ones. Columns of docs."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text. Columns of docs."""
    return exact_dedup.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with shingle similarity of 0.8 or more over five words. Columns of docs.

    The pigeonring over fingerprints finds the first links; the others, which fingerprints can't all show, come from
    prefix filtering of the shingle sets. Every link is checked on the shingles in full.
    """
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    got = packing.pack(docs, word_tokenizer())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup_filter),
    ("simhash_near_dedup", near_dedup),
    ("packing", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
