"""Registered section queries: headings, titles, section records, section search, match snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import fixtures as X
from citeloom.catalog.registry import Tables, query
from citeloom.functions import text as TX
from citeloom.operators import sections as N
from citeloom.plans import section_index as SI
from citeloom.session import scratch_path
from citeloom.sources import sinks as K

# Documents with front matter (every second), a level-1 heading (every third), sections and markup, from the given texts.
_HEAD2, _HEAD3 = r"(?m)^([AEI][^\n]{0,30})", r"(?m)^([OD][^\n]{0,20})"


def markdown_docs(t: Tables):
    n = F.col("doc_id")
    body = F.regexp_replace(F.regexp_replace("text", _HEAD2, "## $1\n"), _HEAD3, "### $1\n")
    body = F.regexp_replace(body, " (the|und|de|la) ", " [$1](x.html) [[3]](#src-3) **$1** ")
    front = F.when(n % 2 == 0, F.concat(F.lit('---\ntitle: "Doc '), n.cast("string"), F.lit('"\n---\n'))).otherwise("")
    head = F.when(n % 3 == 0, F.concat(F.lit("#  Heading "), n.cast("string"), F.lit("\n"))).otherwise("")
    slug = F.concat(F.when(n % 50 == 0, "00-").otherwise(""), F.lit("d"), n.cast("string"))
    return t.documents.select(slug.alias("slug"), F.concat(front, head, body, F.lit("\n## Sources\n1. x\n")).alias("text"))


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\?\[\\?\[(\d+)\\?\]\\?\]\(#src-\d+\)', '', 'g'),
  '<a id="[^"]*"></a>', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#*`>|]', ' ', 'g'), '\s+', ' ', 'g'))"""
_ANCHOR = r"replace(trim(regexp_replace(lower(trim({0}, E' \t\n')), '[^a-z0-9 _-]', '', 'g')), ' ', '-')"

SECTIONS_SQL = rf"""
md AS (
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '00-' ELSE '' END || 'd' || doc_id AS slug,
    CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || '---' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN '#  Heading ' || doc_id || chr(10) ELSE '' END
    || regexp_replace(regexp_replace(regexp_replace(text, '{_HEAD2}', '## \1' || chr(10), 'g'), '{_HEAD3}', '### \1' || chr(10), 'g'),
        ' (the|und|de|la) ', ' [\1](x.html) [[3]](#src-3) **\1** ', 'g') || chr(10) AS body FROM documents),
titled AS (
  SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id WHEN doc_id % 3 = 0 THEN 'Heading ' || doc_id
    ELSE coalesce(nullif(trim(regexp_extract(body, '(?m)^#\s+([^\n]+)$', 1)), ''), slug) END AS title FROM md),
parts AS (
  SELECT slug, title, CAST(unnest(generate_series(0, len(ps) - 1)) AS INTEGER) AS ordinal, unnest(ps) AS p
  FROM (SELECT slug, title, string_split(regexp_replace(body, '(?m)^#{{2,3}}\s+([^\n]+)$', chr(29) || '\1' || chr(31), 'g'), chr(29)) AS ps FROM titled)),
pieces AS (
  SELECT slug, title, ordinal, CASE WHEN ordinal > 0 THEN trim(split_part(p, chr(31), 1), E' \t\n') END AS heading,
    CASE WHEN ordinal > 0 THEN substring(p, strpos(p, chr(31)) + 1) ELSE p END AS content FROM parts),
cleaned AS (SELECT *, {_CLEAN.format('content')} AS c, CASE WHEN starts_with(slug, '00') THEN '' ELSE 'docs/' END || slug || '.html' AS page FROM pieces),
sections AS (
  SELECT slug, ordinal, slug || '#' || CASE WHEN ordinal = 0 THEN 'top' ELSE {_ANCHOR.format('heading')} END AS id, title AS doc,
    CASE WHEN ordinal = 0 THEN 'Overview' ELSE {_CLEAN.format('heading')} END AS section,
    CASE WHEN ordinal = 0 THEN page ELSE page || '#' || {_ANCHOR.format('heading')} END AS url,
    c AS text
  FROM cleaned WHERE ordinal > 0 OR length(c) > 0)"""


@query("sections", f"WITH {SECTIONS_SQL} SELECT slug, ordinal, id, doc, section, url, text FROM sections")
def sections(t: Tables):
    return N.sections(markdown_docs(t))


@query("sink_search_records", f"WITH {SECTIONS_SQL} SELECT id, doc, section, url, text FROM sections")
def sink_search_records(t: Tables):
    """Section records written as sharded JSON and read back."""
    path = scratch_path(t.spark, "search-records")
    K.write_search_records(N.sections(markdown_docs(t)).select("id", "doc", "section", "url", "text"), path)
    return t.spark.read.schema("id string, doc string, section string, url string, text string").json(path)


@query("section_pairing", f"WITH {SECTIONS_SQL} SELECT slug, ordinal, heading, length(content) AS chars FROM pieces")
def section_pairing(t: Tables):
    rows = markdown_docs(t).select("slug", F.posexplode(N.section_array(F.col("text"))).alias("ordinal", "s"))
    return rows.select("slug", "ordinal", "s.heading", F.length("s.content").cast("bigint").alias("chars"))


@query("doc_title", f"WITH {SECTIONS_SQL} SELECT slug, title FROM titled")
def doc_title(t: Tables):
    return markdown_docs(t).select("slug", TX.document_title(F.col("text"), F.col("slug")).alias("title"))


@query("markdown_clean", f"WITH {SECTIONS_SQL} SELECT slug, {_CLEAN.format('body')} AS text FROM md")
def markdown_clean(t: Tables):
    docs = markdown_docs(t)
    return docs.select("slug", TX.markdown_clean(TX.strip_bibliography(F.col("text"))).alias("text"))


@query("heading_anchor", f"""
SELECT p_partkey, {_ANCHOR.format("'  ' || p_name || ': ' || p_brand || ' & (' || p_type || ')  '")} AS anchor FROM part""")
def heading_anchor(t: Tables):
    heading = F.concat(F.lit("  "), "p_name", F.lit(": "), "p_brand", F.lit(" & ("), "p_type", F.lit(")  "))
    return t.part.select("p_partkey", TX.heading_anchor(heading).alias("anchor"))


# Every benchmark text is a question; a word of it cut short is another, to meet the prefix fallback.
_STEM = "([a-zA-Z]{7,})[a-z]{2}"
_ASKED_SQL = f"""
asked AS (SELECT item_id AS qid, text FROM benchmark
  UNION ALL SELECT -1 - item_id, regexp_extract(text, '{_STEM}', 1) FROM benchmark WHERE regexp_matches(text, '{_STEM}'))"""


def asked(t: Tables):
    stem = F.regexp_extract("text", _STEM, 1)
    stems = t.benchmark.select((-1 - F.col("item_id")).alias("qid"), stem.alias("text")).filter(F.col("text") != "")
    return X.benchmark_queries(t).unionByName(stems)


def _field_sql(field: str, boost: float) -> str:
    f = field
    return f"""
{f}_words AS (SELECT id, {X.TOKENS.format(f)} AS ws FROM recs),
{f}_stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS avg_dl FROM {f}_words),
{f}_post AS (SELECT id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM {f}_words) GROUP BY ALL),
{f}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {f}_post GROUP BY term),
{f}_w AS (SELECT id, term, {boost} * greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS w
  FROM {f}_post JOIN {f}_df USING (term), {f}_stats)"""


_SEARCH_SQL = f"""
WITH {SECTIONS_SQL}, {_ASKED_SQL},
recs AS (SELECT slug || '/' || ordinal AS id, section, doc, text FROM sections),
{_field_sql('section', 5.0)}, {_field_sql('doc', 3.0)}, {_field_sql('text', 1.0)},
w AS (SELECT * FROM section_w UNION ALL SELECT * FROM doc_w UNION ALL SELECT * FROM text_w),
dict AS (SELECT DISTINCT term FROM w),
qw AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT qid, unnest({X.TOKENS.format('text')}) AS term FROM asked) GROUP BY ALL),
known AS (SELECT * FROM qw WHERE term IN (SELECT term FROM dict)),
used AS (SELECT * FROM known UNION ALL
  SELECT qid, d.term, sum(times) FROM qw JOIN dict d ON starts_with(d.term, qw.term) WHERE qid NOT IN (SELECT qid FROM known) GROUP BY qid, d.term),
s AS (SELECT qid, id, sum(times * w) AS score FROM used JOIN w USING (term) GROUP BY qid, id),
hits AS (SELECT * FROM (SELECT qid, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank0 FROM s) WHERE rank0 < 40)"""


def section_hits(t: Tables):
    index = SI.SectionIndex(scratch_path(t.spark, "section-index"))
    SI.build(index, N.sections(markdown_docs(t)).select(
        F.concat("slug", F.lit("/"), F.col("ordinal").cast("string")).alias("id"), "section", "doc", "text"))
    return SI.search(index, asked(t))


@query("section_search", f"{_SEARCH_SQL} SELECT qid, id, round(score, 5) AS score, rank0 FROM hits")
def section_search(t: Tables):
    """Whole benchmark texts as questions, and a word of each cut short."""
    return section_hits(t).select("qid", "id", F.round("score", 5).alias("score"), "rank0")


@query("search_top40", f"""
{_SEARCH_SQL} SELECT qid, id, round(score, 5) AS score FROM hits ORDER BY hits.score DESC, qid, id LIMIT 40""")
def search_top40(t: Tables):
    """Best hits of all questions in one list: a take-ordered, not a sort."""
    best = section_hits(t).orderBy(F.round("score", 9).desc(), "qid", "id").limit(N.RESULTS)
    return best.select("qid", "id", F.round("score", 5).alias("score"))


@query("match_snippet", r"""
WITH q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(b.text, E' \n\t\r'), '\s+'), lambda w: regexp_replace(w, '[^a-zA-Z0-9_]', '', 'g')), lambda w: length(w) > 1) AS ts
  FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS k, text FROM documents) d JOIN (SELECT item_id AS k, text FROM benchmark) b USING (k)),
h AS (SELECT doc_id, d_text AS text, ts, coalesce(list_filter(list_transform(ts, lambda w: strpos(lower(d_text), lower(w))), lambda p: p > 0)[1], 0) AS spot FROM (SELECT q.doc_id, d.text AS d_text, q.ts FROM q JOIN documents d USING (doc_id))),
w AS (SELECT doc_id, ts, spot, CASE WHEN spot = 0 THEN substring(text, 1, 260) ELSE substring(text, greatest(spot - 90, 1), spot + 200 - greatest(spot - 90, 1)) END AS s FROM h),
e AS (SELECT doc_id, ts, spot, replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s FROM w)
SELECT doc_id, CASE WHEN spot > 91 THEN '… ' ELSE '' END
  || list_reduce(list_prepend(s, ts), lambda acc, x: regexp_replace(acc, '(?i)(' || x || ')', '<mark>\1</mark>', 'g')) || ' …' AS snippet FROM e""")
def match_snippet(t: Tables):
    asked = t.benchmark.select(F.col("item_id").alias("k"), F.col("text").alias("q"))
    rows = t.documents.withColumn("k", F.col("doc_id") % t.benchmark.count()).join(asked, "k")
    terms = TX.search_terms(F.col("q"))
    return rows.select("doc_id", TX.match_snippet(F.col("text"), terms).alias("snippet"))
