"""Discharge event log: normalise, flag, summarise, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.discharge import is_no_discharge, parse_event_date, volume_mg
from citeloom.session import small_side


def normalise(raw: DataFrame, gallon_stations: list[str]) -> DataFrame:
    """raw(station, year, date, volume, …) + date_iso, span_days, volume_mg, row_type, flags. Raw cells stay."""
    dated = raw.withColumn("_d", parse_event_date(F.col("date")))
    row_type = F.when(is_no_discharge(F.col("volume")), "no_discharge").when(F.col("_d.date_iso").isNull(), "anomaly").otherwise("event")
    return dated.withColumn("row_type", row_type).select(
        *raw.columns, "_d.date_iso", "_d.span_days",
        volume_mg(F.col("station"), F.col("volume"), gallon_stations).alias("volume_mg"), "row_type",
        F.when(F.col("row_type") == "no_discharge", F.array().cast("array<string>")).otherwise(F.col("_d.flags")).alias("flags"))


def counted(log: DataFrame) -> DataFrame:
    """Rows that enter totals: markers and anomalies stay in the log but are left out here."""
    return log.filter(F.col("row_type") == "event")


def station_summary(log: DataFrame) -> DataFrame:
    """Per station: events, total, first and latest date, years without discharge (as a sorted list)."""
    event = F.col("row_type") == "event"
    quiet = F.when(F.col("row_type") == "no_discharge", F.col("year").cast("int"))
    return log.groupBy("station").agg(
        F.count_if(event).alias("events"), F.sum(F.when(event, F.col("volume_mg"))).alias("total_mg"),
        F.min(F.when(event, F.col("date_iso"))).alias("first_event"), F.max(F.when(event, F.col("date_iso"))).alias("latest_event"),
        F.array_join(F.sort_array(F.collect_set(quiet)).cast("array<string>"), ", ").alias("quiet_years"))


def annual_volume(log: DataFrame, named: list[str]) -> DataFrame:
    """Year by station group: the named stations and all others together."""
    group = F.when(F.col("station").isin(*named), F.col("station")).otherwise("other")
    rows = counted(log).select(F.year("date_iso").alias("year"), group.alias("grp"), "volume_mg")
    return rows.groupBy("year").pivot("grp", [*named, "other"]).agg(F.sum("volume_mg")).na.fill(0.0)


def top_events(log: DataFrame, n: int = 10) -> DataFrame:
    """Largest single events; the date shows how many days it went on."""
    shown = F.concat(F.col("date_iso").cast("string"), F.when(F.col("span_days") > 0, F.concat(
        F.lit(" (+"), F.col("span_days").cast("string"), F.lit("d)"))).otherwise(""))
    rows = counted(log).orderBy(F.col("volume_mg").desc(), "date_iso", "station", "row_id").limit(n)
    return rows.select("row_id", shown.alias("date"), "station", "volume_mg")


def row_type_counts(log: DataFrame) -> DataFrame:
    """Rows per type and rows per parse flag."""
    tags = F.concat(F.array(F.concat(F.lit("type:"), "row_type")), F.transform("flags", lambda f: F.concat(F.lit("flag:"), f)))
    return log.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))


def out_of_domain(log: DataFrame, stations: DataFrame) -> DataFrame:
    """stations(station, opened date): events before the opening and rows without a date get flags; nothing is dropped.

    Stations are few against the log, so the log is not shuffled by station while a count shows that they are.
    """
    joined = log.join(small_side(stations), "station", "left")
    extra = F.array_compact(F.array(
        F.when(F.col("date_iso") < F.col("opened"), "before-opening"), F.when(F.col("date_iso").isNull(), "dateless")))
    return joined.withColumn("flags", F.array_union("flags", extra)).withColumn(
        "in_totals", (F.col("row_type") == "event") & (F.size(extra) == 0)).drop("opened")


def reconcile(parts: DataFrame, stated: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Sum of parts against the stated total(key, stated) of each group."""
    sums = parts.groupBy(key).agg(F.sum(value).alias("parts"), F.count(F.lit(1)).alias("n_parts"))
    delta = F.coalesce("parts", F.lit(0.0)) - F.col("stated")
    return stated.join(sums, key, "left").withColumn("delta", delta).withColumn("agrees", F.abs(delta) <= tolerance)


def gallery_counts(images: DataFrame, restricted: Column) -> DataFrame:
    """Images by subject and era, published and rights-restricted."""
    return images.groupBy("subject", "era").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(~restricted).alias("published"), F.count_if(restricted).alias("restricted"))


def volume_windows(events: DataFrame, column: str = "ts", width: str = "1 day") -> DataFrame:
    """Batch form of the rolling volume log: station, window start, events, volume."""
    return events.groupBy("station", F.window(column, width)).agg(
        F.count(F.lit(1)).alias("events"), F.sum("volume").alias("volume")).select(
        "station", F.col("window.start").alias("start"), "events", "volume")
