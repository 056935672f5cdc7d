"""Views of the given tables under the library's data model, in Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.catalog.registry import Tables
from citeloom.plans import keyword_index as K
from citeloom.plans.keyword_index import KeywordIndex
from citeloom.session import scratch_path


def file_of(doc_id: str = "doc_id", source: str = "source") -> Column:
    """A path per document: its source is the folder, three kinds of extension."""
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".txt"), F.lit(".md")), (F.col(doc_id) % 3 + 1).cast("int"))
    return F.concat(F.lit("sources/"), F.col(source), F.lit("/"), F.col(doc_id).cast("string"), ext)


FILE_SQL = (
    "('sources/' || source || '/' || doc_id || (CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.md' END))"
)


def page_rows(t: Tables) -> DataFrame:
    """A line of a document is a page, numbered from 1."""
    lines = t.documents.select("doc_id", file_of().alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", "file", (F.col("pos") + 1).alias("page"), "text")


PAGES_SQL = f"""
page_rows AS (
  SELECT doc_id, {FILE_SQL} AS file, CAST(unnest(generate_series(1, len(ls))) AS INTEGER) AS page, unnest(ls) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)
)"""


_INDEXES: dict[tuple, KeywordIndex] = {}


def keyword_index(t: Tables) -> KeywordIndex:
    """The index of the documents of a folder, built when first asked for and kept for the application as long as the
    table's files stay as they are."""
    files = t.spark.read.parquet(f"{t.folder}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    key = (t.spark.sparkContext.applicationId, t.folder, tuple(sorted(map(tuple, files.distinct().collect()))))
    if key not in _INDEXES:
        index = KeywordIndex(scratch_path(t.spark, "keywords"))
        K.add(index, documents_as_items(t), 0)
        K.refresh(t.spark, index)
        _INDEXES[key] = index
    return _INDEXES[key]


def documents_as_items(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def letter_embedder(letters: str):
    """A stand-in for an embedding model that SQL can state: how often each letter occurs."""
    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(text.count(x)) for x in letters] for text in texts]

    return embed


def benchmark_vectors(t: Tables) -> DataFrame:
    """The vector of a benchmark text is the one with its number."""
    return t.benchmark.select(F.col("item_id").alias("qid"), "text").join(
        t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), "qid", "left"
    )


def documents_as_chunks(t: Tables) -> DataFrame:
    """A document as one chunk: pages are its lines."""
    return t.documents.select(
        F.col("doc_id").alias("id"), file_of().alias("file"), F.lit(1).alias("page_start"),
        F.size(F.split("text", "\n")).alias("page_end"), "text",
    )


CHUNKS_SQL = f"""
chunk_rows AS (
  SELECT doc_id AS id, {FILE_SQL} AS file, 1 AS page_start, CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_end, text
  FROM documents
)"""

TOKENS = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(queries: str, docs: str, k: int, min_chars: int = 3, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}text_hits(qid, id, score, rank0)``; queries(qid, text), docs(id, text) are relations."""
    p = prefix
    return f"""
{p}words AS (
  SELECT qid, lower(w) AS term, CAST(count(*) AS DOUBLE) AS times
  FROM (SELECT qid, unnest(regexp_extract_all(text, '[a-zA-Z0-9]{{{min_chars},}}')) AS w FROM {queries})
  GROUP BY ALL),
{p}doc_words AS (SELECT id, {TOKENS.format('text')} AS ws FROM {docs}),
{p}stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS avg_dl FROM {p}doc_words),
{p}post AS (
  SELECT id, dl, term, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM {p}doc_words) GROUP BY ALL),
{p}dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {p}post GROUP BY term),
{p}scored AS (
  SELECT qid, id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM {p}words JOIN {p}post USING (term) JOIN {p}dfs USING (term), {p}stats GROUP BY qid, id),
{p}text_hits AS (
  SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank0
  FROM {p}scored) WHERE rank0 < {k})"""


def vector_sql(queries: str, items: str, k: int, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}vector_hits``; queries(qid, vector), items(id, vector) are relations."""
    p = prefix
    return f"""
{p}pairs AS (
  SELECT qid, id, list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(i.vector AS DOUBLE[])) AS score
  FROM {queries} q, {items} i WHERE q.vector IS NOT NULL),
{p}vector_hits AS (
  SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank0
  FROM {p}pairs) WHERE rank0 < {k})"""


def rrf_sql(k: int, prefix: str = "", vector: str | None = None, text: str | None = None) -> str:
    """CTE ``{prefix}fused(qid, id, score, rank0)`` over the two hit lists."""
    v, x = vector or f"{prefix}vector_hits", text or f"{prefix}text_hits"
    return f"""
{prefix}fused AS (
  SELECT * FROM (
    SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vr NULLS LAST, tr NULLS LAST) - 1 AS INTEGER) AS rank0
    FROM (SELECT qid, id, v.rank0 AS vr, t.rank0 AS tr,
                 coalesce(1.0::DOUBLE / (60 + v.rank0), 0) + coalesce(1.0::DOUBLE / (60 + t.rank0), 0) AS score
          FROM {v} v FULL JOIN {x} t USING (qid, id))) WHERE rank0 < {k})"""


QUERY_TEXTS = "(SELECT item_id AS qid, text FROM benchmark)"
DOC_TEXTS = "(SELECT doc_id AS id, text FROM documents)"
QUERY_VECTORS = "(SELECT item_id AS qid, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"
ITEM_VECTORS = "(SELECT vec_id AS id, embedding AS vector FROM embeddings)"
