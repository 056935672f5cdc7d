"""Batch questions against built index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.operators import retrieval as R
from citeloom.plans import keyword_index
from citeloom.plans.index_build import Index
from citeloom.session import materialize, small_side


def search(spark: SparkSession, index: Index, vectors: str, queries: DataFrame, k: int = 12) -> DataFrame:
    """queries(qid, text, vector) → response rows; ``vectors`` is the vector table version to use."""
    chunks = spark.read.parquet(index.chunks)
    items = spark.read.parquet(vectors).select("id", F.col("embedding").alias("vector"))
    hits = R.hybrid_search(queries, None, items, k, keyword_index.searcher(index.keywords))
    return R.hit_projection(R.hydrate(small_side(materialize(hits, "hits")), chunks))
