"""Nested timelines → flat events, links and facet counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def split_source_ref(ref: Column) -> Column:
    """``path p.5`` → struct(path, page); page is null when none is named."""
    page = F.regexp_extract(ref, r"\s+pp?\.\s*(\d+)", 1)
    return F.struct(F.btrim(F.regexp_replace(ref, r"\s+pp?\.\s*\d+(?:-\d+)?.*$", "")).alias("path"),
                    F.nullif(page, F.lit("")).cast("int").alias("page"))


def flatten(bundles: DataFrame) -> DataFrame:
    """bundles(bundle, doc) → one row per event with its era and the ordinals of both."""
    eras = bundles.select("bundle", F.posexplode("doc.eras").alias("era_no", "era"))
    events = eras.select("bundle", "era_no", F.col("era.range").alias("era_range"), F.col("era.title").alias("era_title"),
                         F.posexplode("era.events").alias("event_no", "e"))
    return events.select("bundle", "era_no", "era_range", "era_title", "event_no", "e.*")


def source_rows(events: DataFrame) -> DataFrame:
    """One row per source reference of an event, split into path and page."""
    rows = events.select("bundle", "era_no", "event_no", F.posexplode("sources").alias("pos", "ref"))
    return rows.withColumn("_r", split_source_ref(F.col("ref"))).select("bundle", "era_no", "event_no", "pos", "_r.path", "_r.page")


def link_rows(events: DataFrame) -> DataFrame:
    """One row per labelled link of an event."""
    rows = events.select("bundle", "era_no", "event_no", F.posexplode("srclinks").alias("pos", "l"))
    return rows.select("bundle", "era_no", "event_no", "pos", "l.label", "l.href")


def facet_counts(events: DataFrame) -> DataFrame:
    """Events per bundle and per value of each facet (era, kind, weight, system); one pass, one shuffle of counts."""
    facets = F.concat(
        F.array(F.struct(F.lit("bundle").alias("facet"), F.col("bundle").alias("value")),
                F.struct(F.lit("era").alias("facet"), F.col("era_range").alias("value")),
                F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value")),
                F.struct(F.lit("weight").alias("facet"), F.col("weight").alias("value"))),
        F.transform(F.coalesce("system", F.array().cast("array<string>")), lambda s: F.struct(F.lit("system").alias("facet"), s.alias("value"))))
    return events.select("bundle", F.explode(facets).alias("f")).groupBy("bundle", "f.facet", "f.value").agg(
        F.count(F.lit(1)).alias("events"))
