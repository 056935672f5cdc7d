"""Registered queries of this subpackage: a key, a builder over (spark, folder) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm import (chat_format, embedding_dedup, html_text, importance, mixing, ngram_join, oracles, packing, quality_rules, secret_scans,
                          token_alignment, token_counts, url_filters, warc)
from citeloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 2048


def query(key: str, sql: str | None = None):
    """Register a builder under ``key``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    table = token_counts.prefix_table(docs, public_tokenizers.path("word_bpe_49k.json"), stored=False)
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op2_url_filters")
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    model = url_filters.train(url_filters.labelled_urls(spark))
    return url_filters.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


@query("op3_warc", oracles.WARC)
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive, index = warc.write_archive(read_table(spark, folder, "pages"))
    return warc.read_archive(archive, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_ngram_join", oracles.NGRAM_JOIN)
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(read_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_secret_scans", oracles.SECRET_SCANS)
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scans.scan(read_table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    return found.select(
        "doc_id", *[secret_scans.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scans.span_list(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        secret_scans.span_list(spans).alias("spans"))


@query("op6_chat_format", oracles.CHAT_FORMAT)
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"  # fixed value of the contract
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = chat_format.format_trees(chat_format.linear_nodes(rows.unionByName(extra)))
    turns, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_mask"))
    read = done.select("tree", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("formatted_chars"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


@query("op7_embedding_dedup", oracles.EMBEDDING_DEDUP)
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, folder, "embeddings"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_packing")
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_quality_rules", oracles.QUALITY_RULES)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read_table(spark, folder, "pages"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
