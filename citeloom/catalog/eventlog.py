"""Registered event-log queries. The events table stands for the raw log: station = event type, volume = value."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import Tables, query
from citeloom.operators import eventlog as E
from citeloom.session import scratch_path
from citeloom.sources import readers as S

GALLONS = ["view"]

# What the raw cells were made from: the day of an event moved back up to 7000 days, and one of six cell shapes.
LOG_SQL = """
log AS (
  SELECT *, CASE kind WHEN 'marker' THEN NULL WHEN 'anomaly' THEN NULL ELSE b END AS date_iso,
    CAST(CASE WHEN kind IN ('marker', 'anomaly') THEN NULL WHEN kind = 'range' THEN event_id % 5 + 1 ELSE 0 END AS INTEGER) AS span_days,
    CASE WHEN kind = 'marker' THEN NULL WHEN event_type = 'view' THEN value / 1000000 ELSE value END AS volume_mg,
    CASE kind WHEN 'marker' THEN 'no_discharge' WHEN 'anomaly' THEN 'anomaly' ELSE 'event' END AS row_type,
    CASE kind WHEN 'range' THEN 'range' WHEN 'slash' THEN 'missing-slash' WHEN 'serial' THEN 'serial' WHEN 'anomaly' THEN 'no-date' ELSE '' END AS flags
  FROM (SELECT event_id AS row_id, event_id, event_type, event_type AS station, value, CAST(CAST(ts AS DATE) - CAST(event_id % 7000 AS INTEGER) AS DATE) AS b,
    CASE WHEN event_id % 20 = 0 THEN 'marker' WHEN event_id % 33 = 1 THEN 'range' WHEN event_id % 50 = 3 THEN 'slash'
         WHEN event_id % 97 = 5 THEN 'serial' WHEN event_id % 501 = 7 THEN 'anomaly' ELSE 'single' END AS kind FROM events))"""


def raw_log(t: Tables):
    n = F.col("event_id")
    b = F.date_sub(F.to_date("ts"), (n % 7000).cast("int"))
    until = F.date_add(b, (n % 5 + 1).cast("int"))
    cell = (
        F.when(n % 20 == 0, "").when(n % 33 == 1, F.concat(F.date_format(b, "M/d"), F.lit("-"), F.date_format(until, "M/d/yy")))
        .when(n % 50 == 3, F.date_format(b, "M/ddyy"))
        .when(n % 97 == 5, F.date_diff(b, F.to_date(F.lit("1899-12-30"))).cast("string"))
        .when(n % 501 == 7, "").otherwise(F.date_format(b, "M/d/yy")))
    return t.events.select(n.alias("row_id"), F.col("event_type").alias("station"), F.year(b).cast("string").alias("year"),
                           cell.alias("date"), F.when(n % 20 == 0, "No Discharge").otherwise(F.col("value").cast("string")).alias("volume"))


def log(t: Tables):
    return E.normalise(raw_log(t), GALLONS)


@query("parse_event_date", f"""
WITH {LOG_SQL} SELECT row_id, CAST(date_iso AS VARCHAR) AS date_iso, span_days, flags FROM log""")
def parse_event_date(t: Tables):
    return log(t).select("row_id", F.col("date_iso").cast("string").alias("date_iso"), "span_days", F.array_join("flags", ",").alias("flags"))


@query("normalise_volume", f"WITH {LOG_SQL} SELECT row_id, station, round(volume_mg, 8) AS volume_mg FROM log")
def normalise_volume(t: Tables):
    return log(t).select("row_id", "station", F.round("volume_mg", 8).alias("volume_mg"))


@query("scan_event_log", f"""
WITH {LOG_SQL} SELECT station, CAST(date_iso AS VARCHAR) AS date_iso, span_days, round(volume_mg, 8) AS volume_mg, row_type, flags FROM log""")
def scan_event_log(t: Tables):
    """The normalised log written as CSV and read back."""
    path = scratch_path(t.spark, "event-log")
    log(t).drop("row_id").withColumn("flags", F.array_join("flags", ";")).write.option("header", "true").csv(path)
    return S.scan_event_log(t.spark, path).select(
        "station", F.col("date_iso").cast("string").alias("date_iso"), "span_days", F.round("volume_mg", 8).alias("volume_mg"),
        "row_type", F.array_join("flags", ";").alias("flags"))


@query("station_summary", f"""
WITH {LOG_SQL}
SELECT station, count(*) FILTER (WHERE row_type = 'event') AS events, round(sum(volume_mg) FILTER (WHERE row_type = 'event'), 4) AS total_mg,
  CAST(min(date_iso) AS VARCHAR) AS first_event, CAST(max(date_iso) AS VARCHAR) AS latest_event,
  string_agg(DISTINCT CAST(year(b) AS VARCHAR), ', ' ORDER BY CAST(year(b) AS VARCHAR)) FILTER (WHERE row_type = 'no_discharge') AS quiet_years
FROM log GROUP BY station""")
def station_summary(t: Tables):
    return E.station_summary(log(t)).select(
        "station", "events", F.round("total_mg", 4).alias("total_mg"), F.col("first_event").cast("string").alias("first_event"),
        F.col("latest_event").cast("string").alias("latest_event"), "quiet_years")


@query("annual_volume", f"""
WITH {LOG_SQL}, c AS (SELECT CAST(year(date_iso) AS INTEGER) AS year, station, volume_mg FROM log WHERE row_type = 'event')
SELECT year, round(coalesce(sum(volume_mg) FILTER (WHERE station = 'purchase'), 0), 4) AS purchase,
  round(coalesce(sum(volume_mg) FILTER (WHERE station = 'error'), 0), 4) AS error,
  round(coalesce(sum(volume_mg) FILTER (WHERE station NOT IN ('purchase', 'error')), 0), 4) AS other FROM c GROUP BY year""")
def annual_volume(t: Tables):
    out = E.annual_volume(log(t), ["purchase", "error"])
    return out.select("year", *[F.round(c, 4).alias(c) for c in ("purchase", "error", "other")])


@query("row_type_counts", f"""
WITH {LOG_SQL}
SELECT 'type:' || row_type AS tag, count(*) AS rows FROM log GROUP BY ALL UNION ALL
SELECT 'flag:' || flags, count(*) FROM log WHERE flags <> '' GROUP BY ALL""")
def row_type_counts(t: Tables):
    return E.row_type_counts(log(t))


@query("exclude_flagged", f"""
WITH {LOG_SQL} SELECT station, count(*) AS events, round(sum(volume_mg), 4) AS volume FROM log WHERE row_type = 'event' GROUP BY station""")
def exclude_flagged(t: Tables):
    return E.counted(log(t)).groupBy("station").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("volume_mg"), 4).alias("volume"))


@query("top_events", f"""
WITH {LOG_SQL}
SELECT row_id, CAST(date_iso AS VARCHAR) || CASE WHEN span_days > 0 THEN ' (+' || span_days || 'd)' ELSE '' END AS date, station, volume_mg
FROM log WHERE row_type = 'event' ORDER BY volume_mg DESC, date_iso, station, row_id LIMIT 10""")
def top_events(t: Tables):
    return E.top_events(log(t))


@query("out_of_domain_event", f"""
WITH {LOG_SQL}, o AS (SELECT station, MAKE_DATE(2008 + length(station), 1, 1) AS opened FROM log GROUP BY station)
SELECT row_id, concat_ws(',', nullif(flags, ''), CASE WHEN date_iso < opened THEN 'before-opening' END, CASE WHEN date_iso IS NULL THEN 'dateless' END) AS flags,
  row_type = 'event' AND NOT coalesce(date_iso < opened, false) AND date_iso IS NOT NULL AS in_totals FROM log JOIN o USING (station)""")
def out_of_domain_event(t: Tables):
    rows = log(t)
    opened = rows.select("station").distinct().withColumn("opened", F.to_date(F.concat((F.length("station") + 2008).cast("string"), F.lit("-01-01"))))
    return E.out_of_domain(rows, opened).select("row_id", F.array_join("flags", ",").alias("flags"), "in_totals")


@query("reconcile_totals", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice AS stated, round(parts, 4) AS parts, n AS n_parts, round(coalesce(parts, 0) - o_totalprice, 4) AS delta,
  abs(coalesce(parts, 0) - o_totalprice) <= 10000 AS agrees FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def reconcile_totals(t: Tables):
    parts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    out = E.reconcile(parts, t.orders.select("o_orderkey", F.col("o_totalprice").alias("stated")), "o_orderkey", "v", 10000)
    return out.select("o_orderkey", "stated", F.round("parts", 4).alias("parts"), "n_parts", F.round("delta", 4).alias("delta"), "agrees")


@query("gallery_counts", """
SELECT source AS subject, lang AS era, count(*) AS images, count(*) FILTER (WHERE doc_id % 10 <> 0) AS published,
  count(*) FILTER (WHERE doc_id % 10 = 0) AS restricted FROM documents GROUP BY ALL""")
def gallery_counts(t: Tables):
    images = t.documents.select("doc_id", F.col("source").alias("subject"), F.col("lang").alias("era"))
    return E.gallery_counts(images, F.col("doc_id") % 10 == 0)
