"""Corpus → index tables: passages, keyword postings with statistics, vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.operators import chunking, figures, resume
from citeloom.operators.backfill import Embedder, backfill
from citeloom.plans import keyword_index
from citeloom.sources import sinks


@dataclass(frozen=True)
class Index:
    """Folders of one index below a shared root."""

    root: str

    @property
    def chunks(self) -> str:
        return f"{self.root}/chunks"

    @property
    def keywords(self) -> keyword_index.KeywordIndex:
        return keyword_index.KeywordIndex(f"{self.root}/keywords")

    @property
    def vectors(self) -> str:
        return f"{self.root}/vectors"


def build_chunks(index: Index, synthesis: DataFrame, pages: DataFrame, described: DataFrame | None = None) -> None:
    """synthesis(file, text) first, then pages(file, page, text) of other files, then described figures.

    Each origin is its own partition, so rebuilding one leaves the others in place.
    """
    docs = chunking.chunk_documents(synthesis).drop("n", "start_at", "end_at")
    rest = resume.pending(pages, synthesis.select("file").distinct(), "file")
    source = chunking.chunk_pages(rest).drop("n", "start_at", "end_at")
    for origin, rows in (("docs", docs), ("source", source)):
        sinks.overwrite_chunks(_tag(rows, origin), index.chunks)
    if described is not None:
        sinks.overwrite_chunks(_tag(figures.figure_chunks(described), "figure"), index.chunks)


def _tag(rows: DataFrame, origin: str) -> DataFrame:
    return rows.withColumn("origin", F.lit(origin))


def add_keywords(index: Index, passages: DataFrame, batch: int) -> None:
    """Take passages(id, text) into the keyword index as batch ``batch``; a first call builds it, a repeated one replaces itself."""
    keyword_index.add(index.keywords, passages.select("id", "text"), batch)


def build_vectors(index: Index, spark: SparkSession, version: int, embed: Embedder, dim: int) -> str:
    """Embed passages that have no vector yet and write the next version of the vector table."""
    chunks = spark.read.parquet(index.chunks).select("id", "file", "text")
    have = (
        spark.createDataFrame([], "id string, embedding array<float>") if version == 0
        else spark.read.parquet(f"{index.vectors}/v={version - 1:08d}")
    )
    new = backfill(chunks, chunks, have, ["file"], embed, dim)
    return sinks.upsert_version(spark, index.vectors, version, new)
