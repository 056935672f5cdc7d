"""Registered corpus queries: sources, chunking, unions, dedupe, text functions of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import fixtures as X
from citeloom.catalog.registry import Tables, query
from citeloom.functions import ids, text as TX, udfs
from citeloom.operators import chunking as C, figures as G
from citeloom.session import scratch_path
from citeloom.sources import readers as S

# ---------------------------------------------------------------- scans


@query("scan_pages", f"""
WITH {X.PAGES_SQL}
SELECT source AS file, page, count(*) AS n, CAST(sum(length(p.text)) AS BIGINT) AS chars
FROM page_rows p JOIN documents USING (doc_id) GROUP BY ALL""")
def scan_pages(t: Tables):
    """Page records written per source folder, read back with the key taken from the path."""
    path = scratch_path(t.spark, "pages")
    rows = X.page_rows(t).select(
        F.split("file", "/")[1].alias("source"), "page", F.lit("plain").alias("method"), "text"
    )
    rows.write.partitionBy("source").json(path)
    pages = S.scan_pages(t.spark, path, r"source=([^/]+)/")
    return pages.groupBy("file", "page").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


def _manifest_lines(t: Tables):
    """Events as an extraction log; every tenth line is cut off in the middle."""
    record = F.to_json(F.struct(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"),
        F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
        F.floor("value").cast("int").alias("pages"), F.lit(0).alias("ocr_pages"), F.col("event_id").alias("chars"),
    ))
    return t.events.select("event_id", record.alias("j")).select(
        F.when(F.col("event_id") % 10 == 0, F.substring("j", 1, 20)).otherwise(F.col("j")).alias("value"))


@query("scan_manifest", """
SELECT 'user/' || user_id AS file, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
       CAST(floor(value) AS INTEGER) AS pages, 0 AS ocr_pages, CAST(event_id AS INTEGER) AS chars, CAST(NULL AS VARCHAR) AS error
FROM events WHERE event_id % 10 <> 0""")
def scan_manifest(t: Tables):
    path = scratch_path(t.spark, "manifest")
    _manifest_lines(t).write.text(path)
    return S.scan_manifest(t.spark, path)


@query("scan_chunks", f"""
WITH {X.CHUNKS_SQL} SELECT CAST(id AS VARCHAR) AS id, file, page_start, page_end, text FROM chunk_rows""")
def scan_chunks(t: Tables):
    path = scratch_path(t.spark, "chunks")
    X.documents_as_chunks(t).withColumn("id", F.col("id").cast("string")).write.json(path)
    return S.scan_chunks(t.spark, path)


@query("scan_corpus_listing", """
SELECT 'g' || (page_id // 50) AS folder, CAST(sum(octet_length(encode(url)) + 1) AS BIGINT) AS length FROM pages GROUP BY ALL""")
def scan_corpus_listing(t: Tables):
    """Page addresses written as text files, fifty to a folder, then listed."""
    path = scratch_path(t.spark, "listing")
    rows = t.pages.select(F.concat(F.lit("g"), F.floor(F.col("page_id") / 50).cast("string")).alias("folder"), F.col("url").alias("value"))
    rows.repartition("folder").write.partitionBy("folder").text(path)
    listed = S.scan_corpus_listing(t.spark, path, r"(?i)\.txt$")
    return listed.groupBy(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("folder")).agg(F.sum("length").alias("length"))


@query("scan_markdown_docs", """
SELECT n_name || '-' || (c_custkey // 500) AS slug, string_agg('- ' || c_name || ' (' || c_mktsegment || ')' || chr(10), '' ORDER BY c_custkey) AS text
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def scan_markdown_docs(t: Tables):
    """Markdown lists of customers per nation, a file for each range of 500 keys, so files do not grow with the table."""
    path = scratch_path(t.spark, "markdown")
    lines = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat("n_name", F.lit("-"), F.floor(F.col("c_custkey") / 500).cast("string")).alias("slug"), "c_custkey",
        F.concat(F.lit("- "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("value"),
    )
    lines.repartition("slug").sortWithinPartitions("slug", "c_custkey").select("slug", "value") \
        .write.partitionBy("slug").text(path)
    return S.scan_markdown_docs(t.spark, path, r"slug=([^/]+)/").select("slug", "text")


# ---------------------------------------------------------------- chunking

CHUNK_CTE = f"""
{X.PAGES_SQL},
tidy AS (
  SELECT doc_id, file, page, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), E' \\t\\r\\f') AS t FROM page_rows),
kept AS (
  SELECT doc_id, file, page, t, sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page) - length(t) - 2 AS o
  FROM tidy WHERE length(t) > 0),
streams AS (
  SELECT doc_id, any_value(file) AS file, string_agg(t || chr(10) || chr(10), '' ORDER BY page) AS st FROM kept GROUP BY doc_id),
steps AS (
  SELECT doc_id, st, CAST(0 AS BIGINT) AS i,
         CASE WHEN length(st) <= 2800 THEN length(st)
              ELSE 2800 - coalesce(list_min([nullif(strpos(reverse(substring(st, 1401, 1400)), chr(10) || chr(10)), 0),
                                             nullif(strpos(reverse(substring(st, 1401, 1400)), ' .'), 0)]), 0) END AS j
  FROM streams
  UNION ALL
  SELECT doc_id, st, j - 400,
         CASE WHEN length(st) <= j + 2400 THEN length(st)
              ELSE j + 2400 - coalesce(list_min([nullif(strpos(reverse(substring(st, j + 1001, 1400)), chr(10) || chr(10)), 0),
                                                 nullif(strpos(reverse(substring(st, j + 1001, 1400)), ' .'), 0)]), 0) END
  FROM steps WHERE j < length(st)),
cut AS (
  SELECT doc_id, i, j, trim(substring(st, i + 1, j - i), E' \\n\\t\\r\\f') AS text FROM steps),
chunks AS (
  SELECT doc_id, file, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, i AS start_at, j AS end_at, text,
         CAST((SELECT max(k.page) FROM kept k WHERE k.doc_id = cut.doc_id AND k.o <= i) AS INTEGER) AS page_start,
         CAST((SELECT max(k.page) FROM kept k WHERE k.doc_id = cut.doc_id AND k.o <= j - 1) AS INTEGER) AS page_end
  FROM cut JOIN streams USING (doc_id) WHERE length(text) > 0)"""

SLUG_SQL = r"(substring(regexp_replace({0}, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 180) || '_' || substring(sha1({0}), 1, 8))"


def all_chunks(t: Tables):
    return C.chunk_documents(t.documents.select(X.file_of().alias("file"), "text"))


@query("chunk_documents", f"""
WITH RECURSIVE {CHUNK_CTE}
SELECT {SLUG_SQL.format('file')} || ':' || n AS id, file, page_start, page_end, text FROM chunks""")
def chunk_documents(t: Tables):
    return all_chunks(t).select("id", "file", "page_start", "page_end", "text")


@query("chunk_ordinal", f"""
WITH RECURSIVE {CHUNK_CTE} SELECT file, n, start_at, end_at FROM chunks""")
def chunk_ordinal(t: Tables):
    """From page rows, through the sorted stream."""
    return C.chunk_pages(X.page_rows(t)).select("file", "n", "start_at", "end_at")


@query("page_at_offset", f"""
WITH RECURSIVE {CHUNK_CTE}
SELECT file, start_at AS at, page_start AS page FROM chunks""")
def page_at_offset(t: Tables):
    pages = X.page_rows(t)
    starts = C.chunk_pages(pages).select("file", F.col("start_at").alias("at"))
    return C.page_at_offset(pages, starts)


@query("drop_blank_pages", r"""
WITH p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g'), E' \t\r\f') AS text FROM documents)
SELECT doc_id, text, count(*) AS n FROM p WHERE length(text) > 0 GROUP BY ALL""")
def drop_blank_pages(t: Tables):
    return C.tidy_pages(X.page_rows(t)).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query("min_length_filter", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) FILTER (WHERE length(x) > 80) AS chunks, count(*) FILTER (WHERE length(x) > 60) AS intros,
       count(*) FILTER (WHERE length(x) >= 40) AS sections, count(*) FILTER (WHERE length(x) > 25) AS claims,
       count(*) FILTER (WHERE length(x) >= 40 AND NOT starts_with(upper(x), 'SKIP')) AS figures
FROM p GROUP BY doc_id""")
def min_length_filter(t: Tables):
    n = F.length("text")
    return X.page_rows(t).groupBy("doc_id").agg(
        F.count_if(n > 80).alias("chunks"), F.count_if(n > 60).alias("intros"),
        F.count_if(n >= 40).alias("sections"), F.count_if(n > 25).alias("claims"),
        F.count_if(G.description_status(F.col("text")) == "figure").alias("figures"),
    )


@query("extract_totals", """
SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS pages,
       CAST(sum(CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, chr(10))) ELSE 0 END) AS BIGINT) AS ocr_pages,
       count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents""")
def extract_totals(t: Tables):
    """Totals of an extraction log; documents with a '.pdf' path stand for scanned ones."""
    log = t.documents.select(
        F.size(F.split("text", "\n")).alias("pages"), file_pages(t).alias("ocr_pages"), F.length("text").alias("chars")
    )
    return log.agg(
        F.sum("pages").alias("pages"), F.sum("ocr_pages").alias("ocr_pages"), F.count(F.lit(1)).alias("docs"),
        F.sum("chars").cast("bigint").alias("chars"),
    )


def file_pages(t: Tables):
    return F.when(X.file_of().endswith(".pdf"), F.size(F.split("text", "\n"))).otherwise(0)


@query("union_corpora", """
WITH a AS (SELECT 'item/' || doc_id AS file, 'doc' AS origin, text FROM documents),
b AS (SELECT 'item/' || page_id * 8 AS file, 'page' AS origin, html AS text FROM pages)
SELECT file, origin, length(text) AS chars FROM a
UNION ALL SELECT file, origin, length(text) FROM b WHERE file NOT IN (SELECT file FROM a)""")
def union_corpora(t: Tables):
    docs = t.documents.select(F.concat(F.lit("item/"), F.col("doc_id").cast("string")).alias("file"), F.lit("doc").alias("origin"), "text")
    pages = t.pages.select(F.concat(F.lit("item/"), (F.col("page_id") * 8).cast("string")).alias("file"),
                           F.lit("page").alias("origin"), F.col("html").alias("text"))
    return C.union_corpora(docs, pages).select("file", "origin", F.length("text").cast("bigint").alias("chars"))


@query("first_wins_dedupe", """
SELECT hash, doc_id, file FROM (
  SELECT md5(text) AS hash, doc_id, source AS file, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r
  FROM documents) WHERE r = 1""")
def first_wins_dedupe(t: Tables):
    rows = t.documents.select(F.md5("text").alias("hash"), "doc_id", F.col("source").alias("file"))
    return C.first_wins(rows, ["hash"], ["file", "doc_id"])


# ---------------------------------------------------------------- identifiers and small text functions


@query("stable_ids", f"""
SELECT doc_id, {SLUG_SQL.format(X.FILE_SQL)} AS slug, {SLUG_SQL.format(X.FILE_SQL)} || ':' || (doc_id % 7) AS chunk_id,
       'fig:' || substring(sha1({X.FILE_SQL} || ':' || (doc_id % 7)), 1, 16) AS figure_id,
       substring(sha1(source || ':' || doc_id || ':' || text), 1, 16) AS cid
FROM documents""")
def stable_ids(t: Tables):
    path, n = X.file_of(), F.col("doc_id") % 7
    return t.documents.select(
        "doc_id", ids.file_slug(path).alias("slug"), ids.chunk_id(path, n).alias("chunk_id"),
        ids.figure_id(path, n).alias("figure_id"),
        ids.claim_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("cid"),
    )


@query("page_label", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = CAST(l_quantity AS INTEGER) THEN 'p.' || l_linenumber
  ELSE 'pp.' || l_linenumber || '-' || CAST(l_quantity AS INTEGER) END AS label FROM lineitem""")
def page_label(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", TX.page_label(
        F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("label"))


@query("snippet", r"""
SELECT doc_id, substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 400) AS snippet FROM documents""")
def snippet(t: Tables):
    return t.documents.select("doc_id", TX.snippet(F.col("text")).alias("snippet"))


@query("query_terms", """
SELECT item_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9]{3,}'), ' OR ') AS search_terms,
       array_to_string(regexp_extract_all(text, '[a-zA-Z0-9]{4,}'), ' OR ') AS claim_terms FROM benchmark""")
def query_terms(t: Tables):
    return t.benchmark.select(
        "item_id", F.array_join(TX.query_terms(F.col("text")), " OR ").alias("search_terms"),
        F.array_join(TX.query_terms(F.col("text"), 4), " OR ").alias("claim_terms"),
    )


_ENTITIES_SQL = "x"
for _name, _char in TX.NAMED_ENTITIES.items():
    _quoted = _char.replace("'", "''")
    # A missing semicolon is forgiven, as browsers do.
    _ENTITIES_SQL = f"regexp_replace({_ENTITIES_SQL}, '{_name}?', '{_quoted}', 'g')"


@query("html_to_text", rf"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
             '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS x FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace({_ENTITIES_SQL}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM s)
SELECT page_id, trim(x, E' \n\t\r\f\v ') AS text FROM u""")
def html_to_text(t: Tables):
    return t.pages.select("page_id", udfs.html_to_text(F.col("html")).alias("text"))


@query("strip_bibliography", """
WITH m AS (SELECT doc_id, text || chr(10) || '## Sources' || chr(10) || '1. ' || text AS x FROM documents)
SELECT doc_id, string_split(x, chr(10) || '## Sources' || chr(10))[1] || chr(10) AS body FROM m""")
def strip_bibliography(t: Tables):
    marked = F.concat("text", F.lit("\n## Sources\n1. "), "text")
    return t.documents.select("doc_id", TX.strip_bibliography(marked).alias("body"))


@query("hydrate_hits", f"""
WITH hits AS (SELECT doc_id % 20 AS qid, doc_id * 2 AS id FROM labels), {X.CHUNKS_SQL}
SELECT qid, id, file, page_start, page_end FROM hits JOIN chunk_rows USING (id)""")
def hydrate_hits(t: Tables):
    from citeloom.operators.retrieval import hydrate

    hits = t.labels.select((F.col("doc_id") % 20).alias("qid"), (F.col("doc_id") * 2).alias("id"))  # half of them unknown
    return hydrate(hits, X.documents_as_chunks(t)).select("qid", "id", "file", "page_start", "page_end")


@query("hit_projection", rf"""
WITH c AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'fig:' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id,
    CASE WHEN doc_id % 3 = 2 THEN replace({X.FILE_SQL}, 'sources/', 'docs/') ELSE {X.FILE_SQL} END AS file,
    CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_end, CAST(1.0 AS DOUBLE) / (60 + doc_id) AS score,
    regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents)
SELECT id, file, 1 AS page_start, page_end, round(score, 5) AS score, substring(flat, 1, 400) AS snippet,
  flat AS "full", starts_with(id, 'fig:') AS is_figure,
  CASE WHEN starts_with(file, 'docs/') AND ends_with(file, '.md') THEN '/' || replace(file, '.md', '.html')
       WHEN ends_with(lower(file), '.pdf') THEN '/' || file || '#page=1' END AS link,
  CASE WHEN starts_with(id, 'fig:') THEN 'figure' WHEN starts_with(file, 'docs/') THEN 'research doc' ELSE 'source' END AS badge
FROM c""")
def hit_projection(t: Tables):
    from citeloom.operators.retrieval import hit_projection as project

    chunks = X.documents_as_chunks(t)
    n = F.col("id")
    rows = chunks.withColumn("score", F.lit(1.0) / (n + 60)).withColumn(
        "file", F.when(n % 3 == 2, F.replace("file", F.lit("sources/"), F.lit("docs/"))).otherwise(F.col("file"))
    ).withColumn("id", F.when(n % 5 == 0, F.concat(F.lit("fig:"), n.cast("string"))).otherwise(n.cast("string")))
    return project(rows)


@query("result_cap", """
SELECT user_id, event_id, rank0 FROM (
  SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) - 1 AS INTEGER) AS rank0
  FROM events) WHERE rank0 < least(user_id, 50)""")
def result_cap(t: Tables):
    """The number of results asked for (here the user number) is capped at 50."""
    from citeloom.operators.retrieval import cap_hits, rank_hits

    hits = rank_hits(t.events.select("user_id", "event_id", "value"), 50, "user_id", "event_id", "value")
    return hits.filter(F.col("rank0") < cap_hits(F.col("user_id"))).select("user_id", "event_id", "rank0")
