"""Registered timeline queries. Every 500 orders make one bundle; a priority is an era, an order an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import Tables, query
from citeloom.operators import timeline as L
from citeloom.session import scratch_path
from citeloom.sources import readers as S

BUNDLES_SQL = """
ev AS (
  SELECT 'b' || (o_orderkey // 500) AS bundle, o_orderpriority AS era_range, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, 'Order ' || o_orderkey AS title,
    (['problem', 'decision', 'construction', 'milestone', 'controversy', 'outcome'])[o_orderkey % 6 + 1] AS kind, o_orderstatus AS weight,
    o_orderkey % 3 AS n_sys, o_custkey FROM orders),
placed AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY bundle ORDER BY era_range) - 1 AS INTEGER) AS era_no,
    CAST(row_number() OVER (PARTITION BY bundle, era_range ORDER BY o_orderkey) - 1 AS INTEGER) AS event_no FROM ev)"""

_KINDS = ("problem", "decision", "construction", "milestone", "controversy", "outcome")


def bundles(t: Tables):
    """Bundles written as script files ``window.NAME = {...};`` and read back."""
    n = F.col("o_orderkey")
    systems = F.slice(F.array(F.lit("mainstream"), F.lit("calumet")), 1, (n % 3).cast("int"))
    ref = F.concat(F.lit("sources/o/"), F.col("o_custkey").cast("string"), F.lit(".pdf p."), (n % 50).cast("string"))
    event = F.struct(
        n.alias("_n"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Order "), n.cast("string")).alias("title"),
        F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (n % 6 + 1).cast("int")).alias("kind"), F.lit("body; text").alias("body"),
        F.col("o_orderstatus").alias("weight"), systems.alias("system"), F.array(ref, F.lit("sources/plain.pdf")).alias("sources"),
        F.array(F.struct(F.lit("link").alias("label"), F.lit("https://x.example/").alias("href"))).alias("srclinks"))
    eras = t.orders.select(F.concat(F.lit("b"), F.floor(n / 500).cast("string")).alias("bundle"), "o_orderpriority", event.alias("e")) \
        .groupBy("bundle", "o_orderpriority").agg(F.sort_array(F.collect_list("e")).alias("events"))
    era = F.struct(F.col("o_orderpriority").alias("range"), F.lit("t").alias("title"), F.lit("l").alias("lede"), "events")
    docs = eras.groupBy("bundle").agg(F.sort_array(F.collect_list(era)).alias("eras"))
    body = F.to_json(F.struct(F.col("bundle").alias("title"), F.lit("lede").alias("lede"), "eras", F.lit("end").alias("footer")))
    path = scratch_path(t.spark, "timelines")
    docs.select("bundle", F.concat(F.lit("window.TIMELINE = "), body, F.lit(";")).alias("value")) \
        .repartition("bundle").write.partitionBy("bundle").text(path)
    return S.scan_timeline_bundles(t.spark, path).select(
        F.col("doc.title").alias("bundle"), "doc")


@query("scan_timeline_bundles", f"""
WITH {BUNDLES_SQL} SELECT bundle, 'lede' AS lede, 'end' AS footer, CAST(count(DISTINCT era_range) AS INTEGER) AS eras FROM placed GROUP BY bundle""")
def scan_timeline_bundles(t: Tables):
    return bundles(t).select("bundle", "doc.lede", "doc.footer", F.size("doc.eras").alias("eras"))


@query("flatten_timeline", f"""
WITH {BUNDLES_SQL} SELECT bundle, era_no, era_range, event_no, year, title, kind, weight FROM placed""")
def flatten_timeline(t: Tables):
    return L.flatten(bundles(t)).select("bundle", "era_no", "era_range", "event_no", "year", "title", "kind", "weight")


@query("split_source_ref", f"""
WITH {BUNDLES_SQL}
SELECT bundle, era_no, event_no, 0 AS pos, 'sources/o/' || o_custkey || '.pdf' AS path, CAST(o_orderkey % 50 AS INTEGER) AS page FROM placed
UNION ALL SELECT bundle, era_no, event_no, 1, 'sources/plain.pdf', NULL FROM placed""")
def split_source_ref(t: Tables):
    return L.source_rows(L.flatten(bundles(t)))


@query("timeline_links", f"""
WITH {BUNDLES_SQL} SELECT bundle, era_no, event_no, 0 AS pos, 'link' AS label, 'https://x.example/' AS href FROM placed""")
def timeline_links(t: Tables):
    return L.link_rows(L.flatten(bundles(t)))


@query("timeline_counts", f"""
WITH {BUNDLES_SQL},
f AS (SELECT bundle, 'bundle' AS facet, bundle AS value FROM placed UNION ALL SELECT bundle, 'era', era_range FROM placed UNION ALL SELECT bundle, 'kind', kind FROM placed
  UNION ALL SELECT bundle, 'weight', weight FROM placed UNION ALL SELECT bundle, 'system', 'mainstream' FROM placed WHERE n_sys >= 1
  UNION ALL SELECT bundle, 'system', 'calumet' FROM placed WHERE n_sys = 2)
SELECT bundle, facet, value, count(*) AS events FROM f GROUP BY ALL""")
def timeline_counts(t: Tables):
    return L.facet_counts(L.flatten(bundles(t)))
