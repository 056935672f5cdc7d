"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; what a stage returns is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns of ``documents``. A document
without text fails the quality rules; null languages and sources are groups of their own; extra columns of ``docs`` are
dropped; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm import mixing, ngram_join, packing, quality_rules, secret_scans
from citeloom.llm.common import materialize, read_table, ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds of their language and source, which junk in up to a third of a source leaves as they are."""
    ready(spark)
    return quality_rules.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    ready(spark)
    return ngram_join.keep_one(docs.select(*COLUMNS), words=NEAR_WORDS, percent=NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and ``n_chars`` counted anew."""
    ready(spark)
    return secret_scans.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ready(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    ready(spark)
    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("secret_scans", secrets), ("mixing", mixture), ("packing", packed)]

#: Tokenisation, the last stage, cannot be said in SQL; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
