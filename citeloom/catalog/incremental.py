"""Registered incremental queries: resume sets, shards, upserts, figures, backfill, approximate search, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import fixtures as X
from citeloom.catalog.corpus import CHUNK_CTE, SLUG_SQL, all_chunks
from citeloom.catalog.registry import Tables, query
from citeloom.functions import text as TX, udfs
from citeloom.functions.ids import hash_shard
from citeloom.operators import ann, backfill as B, chunking as C, figures as G, neighbour_graph, resume as Q, retrieval as R
from citeloom.session import scratch_path
from citeloom.sources import keyed_table as KT, sinks as K
from citeloom.streaming import jobs as J


@query("done_set", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def done_set(t: Tables):
    log = t.events.select("user_id", F.col("event_type").alias("status"))
    return Q.done_set(log, "user_id", "purchase")


@query("hash_shard", """
SELECT doc_id, list_reduce(list_prepend(0, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substring(sha1(source || doc_id), i, 1)) - 1)),
  lambda a, x: (a * 16 + x) % 7)::INTEGER AS shard FROM documents""")
def shard(t: Tables):
    return t.documents.select("doc_id", hash_shard(F.concat("source", F.col("doc_id").cast("string")), 7).alias("shard"))


@query("resume_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(t: Tables):
    return Q.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("complete_in_both", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def complete_in_both(t: Tables):
    return Q.complete_in_both(t.documents, t.labels, "doc_id")


@query("pending_work", """
SELECT 'extract' AS stage, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'describe', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_work(t: Tables):
    """Extraction retries failed items, figure description does not."""
    log = t.labels.select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status"))
    work = t.documents.select("doc_id")
    extract = Q.pending(work, Q.done_set(log, "doc_id"), "doc_id").select(F.lit("extract").alias("stage"), "doc_id")
    describe = Q.pending(work, Q.logged_set(log, "doc_id"), "doc_id").select(F.lit("describe").alias("stage"), "doc_id")
    return extract.unionByName(describe)


@query("sink_append_log", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'done' ELSE 'error' END AS status FROM labels) GROUP BY status")
def sink_append_log(t: Tables):
    """Two appends to one log, read back."""
    path = scratch_path(t.spark, "log")
    log = t.labels.select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status"))
    K.append_log(log.filter("doc_id % 2 = 0"), path)
    K.append_log(log.filter("doc_id % 2 = 1"), path)
    return t.spark.read.schema("doc_id bigint, status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("sink_chunks_overwrite", """
SELECT 'source' AS origin, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'figure', count(*), CAST(sum(page_id) AS BIGINT) FROM pages""")
def sink_chunks_overwrite(t: Tables):
    """A rebuild of the source passages leaves the figure passages alone; one of the docs that finds nothing empties them."""
    path = scratch_path(t.spark, "origins")
    K.overwrite_chunks(t.documents.select(F.col("doc_id").alias("id"), F.lit("source").alias("origin")), path)
    K.overwrite_chunks(t.pages.select(F.col("page_id").alias("id"), F.lit("figure").alias("origin")), path)
    K.overwrite_chunks(t.labels.select(F.col("doc_id").alias("id"), F.lit("docs").alias("origin")), path)
    K.overwrite_chunks(t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("source").alias("origin")), path)
    K.overwrite_chunks(t.labels.filter("false").select(F.col("doc_id").alias("id"), F.lit("docs").alias("origin")), path, ("docs",))
    return t.spark.read.parquet(path).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


@query("sink_index_upsert", """
SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""")
def sink_index_upsert(t: Tables):
    """Batch 0 holds the even ids; batch 1 replaces and adds every third. Taking batch 1 in twice changes nothing."""
    table = KT.KeyedTable(scratch_path(t.spark, "index"), ("id",))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    KT.upsert(t.spark, table, 0, rows.filter("id % 2 = 0"))
    new = rows.filter("id % 3 = 0").withColumn("label", F.col("label") + 100)
    for _ in range(2):
        KT.upsert(t.spark, table, 1, new)
    return KT.read(t.spark, table)


# ---------------------------------------------------------------- figures

_FIGWORDS = r"(?i)\b(figure|fig\.|plate|exhibit|map|diagram|profile|schematic|cross[- ]section|aerial|photograph)\b"
FIGURE_SQL = rf"""
{X.PAGES_SQL},
marked AS (SELECT file, page, CASE WHEN page % 4 = 1 THEN 'See Figure 3. ' || text ELSE text END AS text FROM page_rows WHERE ends_with(file, '.pdf') AND doc_id % 2 = 0),
cand AS (
  SELECT 'fig:' || substring(sha1(file || ':' || page), 1, 16) AS id, file, page,
    CASE WHEN regexp_matches(text, '{_FIGWORDS}') AND length(trim(text)) < 1200 THEN 'caption' WHEN length(trim(text)) < 300 THEN 'sparse' END AS why,
    substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS ocr_snippet FROM marked),
candidates AS (SELECT * FROM cand WHERE why IS NOT NULL)"""


def scanned_pages(t: Tables):
    """Pages of the finished PDFs; every fourth names a figure."""
    pages = X.page_rows(t).withColumn("text", F.when(F.col("page") % 4 == 1, F.concat(F.lit("See Figure 3. "), "text")).otherwise(F.col("text")))
    done = t.documents.filter("doc_id % 2 = 0").select(X.file_of().alias("file"))
    return pages.drop("doc_id").filter(F.lower("file").endswith(".pdf")).join(done, "file", "left_semi")


def candidates(t: Tables):
    return G.figure_candidates(scanned_pages(t))


@query("figure_candidates", f"WITH {FIGURE_SQL} SELECT id, file, page, why, ocr_snippet FROM candidates")
def figure_candidates(t: Tables):
    return candidates(t)


@query("caption_first_order", f"""
WITH {FIGURE_SQL} SELECT id, file, page, why FROM candidates
ORDER BY CASE why WHEN 'caption' THEN 0 ELSE 1 END, file, page""")
def caption_first_order(t: Tables):
    return G.work_order(candidates(t), ["file", "page"]).select("id", "file", "page", "why")


@query("prefix_figure_text", f"""
WITH {FIGURE_SQL} SELECT id, file, page AS page_start, page AS page_end, '[FIGURE — ' || file || ' p.' || page || '] ' || ocr_snippet AS text
FROM candidates WHERE length(ocr_snippet) >= 40""")
def prefix_figure_text(t: Tables):
    described = candidates(t).withColumn("description", F.col("ocr_snippet"))
    return G.figure_chunks(described.withColumn("status", G.description_status(F.col("description"))))


@query("corpus_stats", f"""
WITH RECURSIVE {CHUNK_CTE}, {FIGURE_SQL.replace(X.PAGES_SQL + ",", "")},
kept_figures AS (SELECT file FROM candidates WHERE length(ocr_snippet) >= 40),
every AS (SELECT file, false AS figure FROM chunks UNION ALL SELECT file, true FROM kept_figures)
SELECT count(DISTINCT file) AS docs, count(*) AS chunks, count(*) FILTER (WHERE figure) AS figures,
  (SELECT count(DISTINCT file) FROM marked) AS scanned_docs, (SELECT count(*) FROM marked) AS scanned_pages,
  (SELECT count(*) FROM candidates) AS candidates FROM every""")
def corpus_stats(t: Tables):
    """Totals of an index with its figure passages, and of the scan that found them."""
    described = candidates(t).withColumn("description", F.col("ocr_snippet"))
    figures = G.figure_chunks(described.withColumn("status", G.description_status(F.col("description")))).select("id", "file")
    index = all_chunks(t).select("id", "file").unionByName(figures)
    return C.corpus_totals(index).join(C.scan_totals(scanned_pages(t), candidates(t)))


@query("append_new_only", """
SELECT doc_id AS id, 'old' AS origin FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 6 = 0""")
def append_new_only(t: Tables):
    old = t.documents.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.lit("old").alias("origin"))
    new = t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("new").alias("origin"))
    return Q.append_new_only(old, new)


# ---------------------------------------------------------------- models


_LETTERS = "etaoin"


@query("embedding_backfill", f"""
SELECT doc_id AS id, array_to_string([{", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in _LETTERS)}], ',') AS embedding
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels JOIN embeddings ON vec_id = doc_id)""")
def embedding_backfill(t: Tables):
    """Vectors for documents that are not complete in both tables; letter counts stand in for a model."""
    docs = X.documents_as_items(t).withColumn("ordinal", F.col("id"))
    have = t.labels.select(F.col("doc_id").alias("id"))
    out = B.backfill(docs, have, X.vectors(t), ["ordinal"], X.letter_embedder(_LETTERS), len(_LETTERS))
    return out.select("id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",").alias("embedding"))


_NEAREST = f"""
WITH {X.vector_sql("(SELECT vec_id AS qid, embedding AS vector FROM embeddings)", X.ITEM_VECTORS, 10)}
SELECT qid, id, rank0, round(score, 5) AS score FROM vector_hits"""


@query("vector_topk_ann", _NEAREST)
def vector_topk_ann(t: Tables):
    """Search over a neighbour graph, each question keeping fewer nodes than there are; tests measure its recall."""
    items = X.vectors(t)
    nodes, edges = neighbour_graph.neighbour_graph(items)
    found = neighbour_graph.graph_topk(items.withColumnRenamed("id", "qid"), nodes, edges, 10, beam=192, expand=64)
    return found.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("vector_topk_cells", _NEAREST)
def vector_topk_cells(t: Tables):
    """With every cell probed the cell search is exact; tests measure its recall with fewer probes."""
    items = X.vectors(t)
    found = ann.vector_topk_ann(items.withColumnRenamed("id", "qid"), items, 10, ann.fit_cells(items, 16), probes=16)
    return found.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("unescape_html", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')
  || CASE WHEN page_id % 2 = 0 THEN ' é§' ELSE '' END AS text FROM pages""")
def unescape_html(t: Tables):
    source = F.concat("html", F.when(F.col("page_id") % 2 == 0, " &eacute;&#167;").otherwise(""))
    return t.pages.select("page_id", udfs.unescape_html(source).alias("text"))


@query("chunk_text_udtf", f"""
WITH RECURSIVE {CHUNK_CTE} SELECT file, n, page_start, page_end, text FROM chunks""")
def chunk_text_udtf(t: Tables):
    """The chunker called from SQL over a table of pages."""
    udfs.register(t.spark)
    X.page_rows(t).createOrReplaceTempView("citeloom_pages")
    return t.spark.sql("SELECT * FROM chunk_text(TABLE(SELECT file, page, text FROM citeloom_pages) PARTITION BY file ORDER BY page)")


# ---------------------------------------------------------------- streams


@query("stream_ingest_chunks", f"""
WITH RECURSIVE {CHUNK_CTE} SELECT {SLUG_SQL.format('file')} || ':' || n AS id, file, page_start, page_end, text FROM chunks""")
def stream_ingest_chunks(t: Tables):
    """Documents arriving in eight files, chunked as a stream in batches of three files."""
    source, target, mark = (scratch_path(t.spark, x) for x in ("docs-in", "chunks-out", "mark"))
    t.documents.select(X.file_of().alias("file"), "text").repartition(8).write.parquet(source)
    stream = J.read_stream(t.spark, source, "file string, text string", files_per_batch=3)
    J.write_stream(J.ingest_chunks(stream), target, mark).awaitTermination()
    return t.spark.read.parquet(target).select("id", "file", "page_start", "page_end", "text")


@query("stream_dedupe_by_id", "SELECT event_id, event_type FROM events")
def stream_dedupe_by_id(t: Tables):
    """Every event arrives twice, and every third once more after its state has ended; one copy stays."""
    source, target, mark = (scratch_path(t.spark, x) for x in ("events-in", "events-out", "mark"))
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for part in (rows.unionByName(rows).repartition(2), rows.filter("event_id % 3 = 0").repartition(1)):
        part.write.mode("append").parquet(source)
        stream = J.read_stream(t.spark, source, "event_id bigint, ts timestamp, event_type string")
        J.dedupe_to_table(stream, target, mark, horizon="0 days", keep_ms=1).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "event_type")


@query("stream_event_rollup", """
SELECT event_type AS station, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 4) AS volume FROM events GROUP BY ALL""")
def stream_event_rollup(t: Tables):
    """Daily volume per station; rows of a day arrive in any micro-batch."""
    source, root, mark = (scratch_path(t.spark, x) for x in ("log-in", "rollup", "mark"))
    t.events.select(F.col("event_type").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("volume")) \
        .repartition(4).write.parquet(source)
    job, table = J.rollup_stream(J.read_stream(t.spark, source, "station string, ts timestamp, volume double", files_per_batch=2), root, mark)
    job.awaitTermination()
    return KT.read(t.spark, table).select("station", F.date_format("start", "yyyy-MM-dd").alias("day"), "events", F.round("volume", 4).alias("volume"))


@query("stream_index_upsert", """
SELECT vec_id AS id, CAST(max(label) AS INTEGER) AS label FROM embeddings GROUP BY vec_id""")
def stream_index_upsert(t: Tables):
    """Vectors arrive in six files; each micro-batch is a batch of the table."""
    source, root, mark = (scratch_path(t.spark, x) for x in ("vec-in", "vec-index", "mark"))
    t.embeddings.select(F.col("vec_id").alias("id"), "label").repartition(6).write.parquet(source)
    job, table = J.upsert_stream(J.read_stream(t.spark, source, "id bigint, label int", files_per_batch=2), root, mark)
    job.awaitTermination()
    return KT.read(t.spark, table).select("id", "label")
