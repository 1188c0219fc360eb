"""From raw documents to token ids: quality, exact and near duplicates, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.llm import byte_bpe, decontaminate, exact_dedup, minhash_dedup, quality
from tidebars.llm.columns import materialize, prepare, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer, trained on these documents' weak labels, does not reject."""
    prepare(spark)
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare(spark)
    return minhash_dedup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and decoded bytes of each document, the latter two as digests."""
    prepare(spark)
    return byte_bpe.digests(byte_bpe.encode(docs))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar),
          ("decontamination", uncontaminated), ("byte_bpe", encoded)]

#: Neither the scorer nor the encoding can be written in SQL; tests compare run() with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
