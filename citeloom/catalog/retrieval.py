"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import fixtures as X
from citeloom.catalog.registry import Tables, query
from citeloom.operators import retrieval as R
from citeloom.plans import keyword_index as K
from citeloom.session import materialize, scratch_path, small_side

_ALL_SELF = "(SELECT vec_id AS qid, embedding AS vector FROM embeddings)"


@query("vector_topk", f"""
WITH {X.vector_sql(_ALL_SELF, X.ITEM_VECTORS, 10)}
SELECT qid, id, rank0, round(score, 5) AS score FROM vector_hits""")
def vector_topk(t: Tables):
    items = X.vectors(t)
    hits = R.vector_topk(items.withColumnRenamed("id", "qid"), items, 10)
    return hits.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("vector_topk_l2", f"""
SELECT qid, id, rank0, round(d, 4) AS distance FROM (
  SELECT qid, id, d, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) - 1 AS INTEGER) AS rank0
  FROM (SELECT q.qid, i.id, list_distance(CAST(q.vector AS DOUBLE[]), CAST(i.vector AS DOUBLE[])) AS d FROM {_ALL_SELF} q, {X.ITEM_VECTORS} i
        WHERE q.qid <> i.id)) WHERE rank0 < 10""")
def vector_topk_l2(t: Tables):
    """Nearest other vectors by distance."""
    items = X.vectors(t)
    hits = R.vector_topk(items.withColumnRenamed("id", "qid"), items, 11, "l2").filter(F.col("qid") != F.col("id"))
    ranked = R.rank_hits(hits.select("qid", "id", "score"), 10)
    return ranked.select("qid", "id", "rank0", F.round(-F.col("score"), 4).alias("distance"))


@query("bm25_index", f"""
WITH d AS (SELECT doc_id AS id, {X.TOKENS.format('text')} AS ws FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM d) GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term""")
def bm25_index(t: Tables):
    """Words of the built index, from its dictionary."""
    return K.dictionary(t.spark, X.keyword_index(t))


@query("term_statistics", f"""
WITH d AS (SELECT doc_id AS id, {X.TOKENS.format('text')} AS ws FROM documents)
SELECT id, CAST(dl AS INTEGER) AS dl, term, CAST(count(*) AS INTEGER) AS tf
FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM d) GROUP BY ALL""")
def term_statistics(t: Tables):
    return R.postings(X.documents_as_items(t))


@query("bm25_topk", f"""
WITH {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 24)}
SELECT qid, id, rank0, round(score, 5) AS score FROM text_hits""")
def bm25_topk(t: Tables):
    hits = K.topk(X.keyword_index(t), X.benchmark_queries(t), 24)
    return hits.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("keyword_index_add", f"""
WITH {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 12)}
SELECT qid, id, rank0, round(score, 5) AS score FROM text_hits""")
def keyword_index_add(t: Tables):
    """An index that took in wrong texts and surplus documents, a batch twice, corrections and removals, merged half-way,
    answers like one filled at once."""
    index, docs = K.KeywordIndex(scratch_path(t.spark, "keywords-added")), X.documents_as_items(t)
    wrong = docs.withColumn("text", F.when(F.col("id") % 4 == 0, F.reverse("text")).otherwise(F.col("text")))
    surplus = docs.filter(F.col("id") % 8 == 0).withColumn("id", -1 - F.col("id"))
    K.add(index, wrong.filter(F.col("id") % 2 == 0).unionByName(surplus), 0)
    for _ in range(2):
        K.add(index, docs.filter(F.col("id") % 2 == 1), 1)
    K.merge(t.spark, index)
    K.add(index, docs.filter(F.col("id") % 4 == 0), 2)
    K.remove(index, surplus, 3)
    hits = K.topk(index, X.benchmark_queries(t), 12)
    return hits.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("topk_per_query", """
SELECT user_id, event_id, value, rank0 FROM (
  SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) - 1 AS INTEGER) AS rank0
  FROM events) WHERE rank0 < 5""")
def topk_per_query(t: Tables):
    hits = R.rank_hits(t.events.select("user_id", "event_id", "value"), 5, "user_id", "event_id", "value")
    return hits.select("user_id", "event_id", "value", "rank0")


@query("rrf_fuse", f"""
WITH {X.vector_sql(X.QUERY_VECTORS, X.ITEM_VECTORS, 24)}, {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 24)}, {X.rrf_sql(8)}
SELECT qid, id, rank0, round(score, 5) AS score FROM fused""")
def rrf_fuse(t: Tables):
    hits = R.hybrid_search(X.benchmark_vectors(t), None, X.vectors(t), 8, K.searcher(X.keyword_index(t)))
    return hits.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


_PROJECTION = r"""
  SELECT qid, rank0, id, file, page_start, page_end, round(score, 5) AS score,
         substring(flat, 1, 400) AS snippet, flat AS "full", false AS is_figure,
         CASE WHEN lower(file) LIKE '%.pdf' THEN '/' || file || '#page=' || page_start END AS link, 'source' AS badge
  FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM fused JOIN chunk_rows USING (id))"""


@query("hybrid_search", f"""
WITH {X.vector_sql(X.QUERY_VECTORS, X.ITEM_VECTORS, 36)}, {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 36)}, {X.rrf_sql(12)},
{X.CHUNKS_SQL} {_PROJECTION}""")
def hybrid_search(t: Tables):
    hits = R.hybrid_search(X.benchmark_vectors(t), None, X.vectors(t), 12, K.searcher(X.keyword_index(t)))
    return R.hit_projection(R.hydrate(small_side(materialize(hits, "hits")), X.documents_as_chunks(t)))
