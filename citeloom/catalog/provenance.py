"""Registered provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import Tables, query
from citeloom.functions import provenance as PF
from citeloom.operators import provenance as P
from citeloom.session import materialize, scratch_path
from citeloom.sources import readers as S, sinks as K
from citeloom.sources.markdown_tables import table_rows

# Files on disk: one or two per web page (a capture and, for every third page, a text extract).
FILES_SQL = """
base AS (SELECT page_id, 'folder' || (page_id % 9) AS folder, '2024-0' || (page_id % 9 + 1) || '-report_epa-' || page_id AS stem FROM pages),
files AS (
  SELECT folder, 'sources/' || folder || '/' || stem || '.pdf' AS file FROM base
  UNION ALL SELECT folder, 'sources/' || folder || '/' || stem || '.txt' FROM base WHERE page_id % 3 = 0)"""

# Ledger lines, as markdown tables state them; a ledger covers fifty pages.
LEDGER_SQL = """
led AS (
  SELECT 'ledger' || (page_id // 50) AS ledger, page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'Title ' || page_id END AS title, url,
    CASE WHEN page_id % 4 = 0 THEN '2024-0' || (page_id % 9 + 1) || '-report_epa-' || page_id || '.pdf' END AS in_file,
    CASE WHEN page_id % 4 = 1 THEN '2024-0' || (page_id % 9 + 1) || '-report_epa-' || page_id || '.pdf' END AS in_note
  FROM pages WHERE page_id % 2 = 0 OR page_id % 4 = 1),
idx AS (
  SELECT 'p' AS kind, in_file AS basename, title, url, ledger FROM led WHERE in_file IS NOT NULL
  UNION ALL SELECT 's', in_note, title, url, ledger FROM led WHERE in_note IS NOT NULL)"""

MATCH_SQL = f"""
{FILES_SQL}, {LEDGER_SQL},
m AS (SELECT folder, file, string_split(file, '/')[-1] AS bn FROM files),
matched AS (
  SELECT folder, file, coalesce(p.title, s.title) AS title, coalesce(p.url, s.url) AS url,
    CASE WHEN p.basename IS NOT NULL THEN 'p' WHEN s.basename IS NOT NULL THEN 's' END AS tier
  FROM m LEFT JOIN (SELECT * FROM idx WHERE kind = 'p') p ON p.basename = bn
         LEFT JOIN (SELECT * FROM idx WHERE kind = 's') s ON s.basename = bn),
stems AS (SELECT *, regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') AS stem FROM matched),
donors AS (SELECT folder, stem, arg_min(title, file) AS dt, arg_min(url, file) AS du FROM stems WHERE title <> '' GROUP BY ALL),
inherited AS (
  SELECT s.folder, s.file, CASE WHEN tier IS NULL THEN dt ELSE title END AS title,
    CASE WHEN tier IS NULL THEN du ELSE url END AS url, CASE WHEN tier IS NULL AND dt IS NOT NULL THEN 'c' ELSE tier END AS tier
  FROM stems s LEFT JOIN donors d ON d.folder = s.folder AND d.stem = s.stem)"""


def _name(n):
    return F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"), F.lit("-report_epa-"), n.cast("string"))


def files(t: Tables):
    n = F.col("page_id")
    folder = F.concat(F.lit("folder"), (n % 9).cast("string"))
    exts = F.when(n % 3 == 0, F.array(F.lit(".pdf"), F.lit(".txt"))).otherwise(F.array(F.lit(".pdf")))
    return t.pages.select(folder.alias("folder"), n, F.explode(exts).alias("ext")).select(
        "folder", F.concat(F.lit("sources/"), "folder", F.lit("/"), _name(n), "ext").alias("file"))


def ledger_docs(t: Tables):
    """Ledgers written as markdown files with prose and one table each, then read back."""
    path = scratch_path(t.spark, "ledgers")
    n = F.col("page_id")
    row = F.concat(
        F.lit("| **"), F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("Title "), n.cast("string"))), F.lit("** | <"), "url",
        F.lit("> see https://other.example/ | "),
        F.when(n % 4 == 0, F.concat(F.lit("`sources/x/"), _name(n), F.lit(".pdf`"))).otherwise("none"), F.lit(" | "),
        F.when(n % 4 == 1, F.concat(F.lit("already held: "), _name(n), F.lit(".pdf"))).otherwise("new"), F.lit(" |"))
    body = t.pages.filter((n % 2 == 0) | (n % 4 == 1)).select(
        F.concat(F.lit("ledger"), F.floor(n / 50).cast("string")).alias("slug"), (n + 10).alias("at"), row.alias("value"))
    slugs = body.select("slug").distinct()
    lead = F.array(*[F.struct(F.lit(i).cast("bigint").alias("at"), F.lit(x).alias("value")) for i, x in enumerate((
        "# Ledger", "| stray | line |", "", "| Title | URL | File held | Notes |", "|---|:---:|---|---|"))])
    lines = slugs.select("slug", F.inline(lead)).unionByName(body)
    lines.repartition("slug").sortWithinPartitions("slug", "at").select("slug", "value").write.partitionBy("slug").text(path)
    return S.scan_markdown_docs(t.spark, path, r"slug=([^/]+)/")


def ledger(t: Tables):
    """The index as a table: matching reads it more than once."""
    return materialize(P.ledger_index(P.ledger_entries(table_rows(ledger_docs(t)))), "ledger-index")


@query("scan_markdown_tables", f"""
WITH {LEDGER_SQL}
SELECT ledger AS slug, CASE WHEN title = '' THEN '****' ELSE '**' || title || '**' END AS title,
       coalesce('`sources/x/' || in_file || '`', 'none') AS held, coalesce('already held: ' || in_note, 'new') AS note FROM led""")
def scan_markdown_tables(t: Tables):
    return table_rows(ledger_docs(t)).select(
        "slug", F.get("cells", F.lit(0)).alias("title"), F.get("cells", F.lit(2)).alias("held"), F.get("cells", F.lit(3)).alias("note"))


@query("ledger_index", f"WITH {LEDGER_SQL} SELECT kind, basename, title, url, ledger FROM idx")
def ledger_index(t: Tables):
    return ledger(t)


@query("provenance_match", f"WITH {MATCH_SQL} SELECT folder, file, title, url, tier FROM matched")
def provenance_match(t: Tables):
    return P.match(files(t), ledger(t))


@query("companion_inherit", f"WITH {MATCH_SQL} SELECT folder, file, title, url, tier FROM inherited")
def companion_inherit(t: Tables):
    return P.inherit(P.match(files(t), ledger(t)))


@query("match_stats", f"""
WITH {MATCH_SQL}
SELECT folder, count(*) AS files, count(*) FILTER (WHERE tier = 'p') AS p, count(*) FILTER (WHERE tier = 's') AS s,
  count(*) FILTER (WHERE tier = 'c') AS c, count(*) FILTER (WHERE tier IS NULL) AS unmatched,
  CAST(grouping(folder) AS INTEGER) AS is_total, round(count(tier) * 100.0 / CAST(count(*) AS DOUBLE), 1) AS percent
FROM inherited GROUP BY ROLLUP (folder)""")
def match_stats(t: Tables):
    return P.match_stats(P.inherit(P.match(files(t), ledger(t))))


@query("sink_manifest", f"""
WITH {MATCH_SQL}
SELECT folder, '`' || file || '`' AS file_cell,
  CASE WHEN coalesce(title, '') <> '' THEN title ELSE 'Report EPA ' || regexp_extract(file, '-([0-9]+)\\.[a-z]+$', 1) END AS title_cell,
  CASE WHEN coalesce(url, '') <> '' THEN '<' || url || '>' ELSE '—' END AS url_cell FROM inherited""")
def sink_manifest(t: Tables):
    """Written partitioned by folder and read back."""
    path = scratch_path(t.spark, "manifest-out")
    K.write_manifest(K.manifest_cells(P.manifest(files(t), ledger(t))), path)
    return t.spark.read.parquet(path).select("folder", "file_cell", "title_cell", "url_cell")


@query("except_docs", f"WITH {MATCH_SQL} SELECT folder, file FROM matched WHERE tier IS NULL")
def except_docs(t: Tables):
    return P.unmatched(files(t), ledger(t))


@query("folder_file_order", f"WITH {FILES_SQL} SELECT folder, file FROM files ORDER BY folder, file")
def folder_file_order(t: Tables):
    """Folders, then files, in name order: one range-partitioned sort."""
    return files(t).orderBy("folder", "file")


@query("eligible_files", r"""
WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/$', '') || CASE page_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt'
  WHEN 2 THEN '/.hidden.md' WHEN 3 THEN '/MANUAL-RETRIEVAL.md' WHEN 4 THEN '/_new/a.htm' ELSE '' END AS path FROM pages)
SELECT page_id, path FROM p WHERE regexp_matches(path, '(?i)\.(pdf|txt|html|htm|md)$') AND page_id % 6 NOT IN (2, 3, 4)""")
def eligible_files(t: Tables):
    kind = F.col("page_id") % 6
    tail = F.when(kind == 0, ".PDF").when(kind == 1, ".txt").when(kind == 2, "/.hidden.md") \
        .when(kind == 3, "/MANUAL-RETRIEVAL.md").when(kind == 4, "/_new/a.htm").otherwise("")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", ""), tail)
    return t.pages.select("page_id", path.alias("path")).filter(S.eligible(F.col("path")))


@query("extract_urls", r"""
SELECT page_id, regexp_extract(html, 'https?://[^\s<>|`\)]+', 0) AS first_url,
  array_to_string(regexp_extract_all(url || ' ' || replace(html, '/', ' x.pdf '), '(?i)[A-Za-z0-9][A-Za-z0-9_%.\-]*\.(?:pdf|html?|txt|xlsx?|jpe?g|png|mp3|md|docx?|csv|json|tsv)\b'), '|') AS names
FROM pages""")
def extract_urls(t: Tables):
    cell = F.concat("url", F.lit(" "), F.replace("html", F.lit("/"), F.lit(" x.pdf ")))
    return t.pages.select("page_id", PF.first_url(F.col("html")).alias("first_url"),
                          F.array_join(PF.file_tokens(cell), "|").alias("names"))


@query("humanize_filename", """
WITH w AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^https?://', ''), '[./?#=&]+', '-', 'g'), '[-_]+'), lambda x: x <> '') AS ws FROM pages)
SELECT page_id, array_to_string(list_transform(ws, lambda x: CASE lower(x) WHEN 'epa' THEN 'EPA' WHEN 'cso' THEN 'CSO' WHEN 'vs' THEN 'vs.' WHEN 'faq' THEN 'FAQ'
   ELSE upper(x[1:1]) || x[2:] END), ' ') || CASE page_id % 3 WHEN 0 THEN ' EPA vs. CSOs' WHEN 1 THEN ' FAQ 2' ELSE ' MS4' END AS title FROM w""")
def humanize_filename(t: Tables):
    n = F.col("page_id")
    base = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[./?#=&]+", "-")
    prefix = F.when(n % 2 == 0, "1999-12-31_").otherwise("undated-")
    tail = F.when(n % 3 == 0, "_epa--vs-csos.pdf").when(n % 3 == 1, "-faq-2.html").otherwise("_ms4")
    return t.pages.select("page_id", PF.humanize(F.concat(prefix, base, tail)).alias("title"))


@query("path_regex_filter", r"""
SELECT page_id, url FROM pages WHERE regexp_matches(url, 'blog\..*example\.(com|org)')""")
def path_regex_filter(t: Tables):
    hits = t.pages.filter(F.col("url").rlike(r"blog\..*example\.(com|org)"))
    return hits.select("page_id", "url")


_CANON_SQL = r"""
canon AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '#.*$', ''), '[?&]utm_[a-z]+=[^&]*', '', 'g'), '/+$', '') AS key,
  lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages),
tiers AS (SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 1 WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 2
  WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 3 ELSE 4 END AS tier FROM canon)"""
_TIERS = {1: ("example.com",), 2: ("example.org",), 3: ("example.net",)}


@query("canonical_url", f"WITH {_CANON_SQL} SELECT page_id, key, host, tier FROM tiers")
def canonical_url(t: Tables):
    url = F.col("url")
    return t.pages.select("page_id", PF.canonical_url(url).alias("key"), PF.url_host(url).alias("host"),
                          PF.url_tier(url, _TIERS).alias("tier"))


_CITATIONS_SQL = f"""
WITH {_CANON_SQL},
c AS (SELECT regexp_replace(regexp_replace(key, '\\?.*$', ''), '[0-9]+(\\.html)?/?$', '') AS key, 'doc' || ((page_id + off) % 17) AS doc
  FROM tiers, (SELECT unnest([0, 3, 7]) AS off))"""


def _citations(t: Tables):
    """Works are page addresses without their number; each page is cited by three documents."""
    n = F.col("page_id")
    work = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"[0-9]+(\.html)?/?$", "")
    pairs = t.pages.select(work.alias("url"), F.explode(F.array(F.lit(0), F.lit(3), F.lit(7))).alias("off"), n)
    return pairs.select("url", F.concat(F.lit("doc"), ((n + F.col("off")) % 17).cast("string")).alias("doc"))


@query("cited_in", _CITATIONS_SQL + " SELECT DISTINCT key, 4 AS tier, doc FROM c")
def cited_in(t: Tables):
    return P.cited_in(_citations(t)).withColumn("key", F.concat("key", F.lit("/")))


@query("citing_counts", _CITATIONS_SQL + " SELECT key, 4 AS tier, count(DISTINCT doc) AS n_docs FROM c GROUP BY key")
def citing_counts(t: Tables):
    return P.citing_counts(_citations(t)).withColumn("key", F.concat("key", F.lit("/")))
