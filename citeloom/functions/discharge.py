"""Expressions that normalise cells of a discharge log."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Day zero of spreadsheet serial dates, two-digit years above this one belong to the last century.
SERIAL_DAY_ZERO, LAST_SHORT_YEAR = "1899-12-30", 26

_RANGE = r"^(\d{1,2})/(\d{1,2})\s*-\s*(?:(\d{1,2})/)?(\d{1,2})/(\d{2}|\d{4})$"
_SINGLE = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
_RUN_ON = r"^(\d{1,2})/(\d{2})(\d{2})$"
_SERIAL = r"^\d{5}(?:\.0)?$"


def _full_year(cell: Column) -> Column:
    y = cell.try_cast("int")
    return F.when(F.length(cell) == 4, y).when(y > LAST_SHORT_YEAR, y + 1900).otherwise(y + 2000)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_event_date(cell: Column) -> Column:
    """Struct(date_iso, span_days, flags) of a raw date cell.

    Single dates, ranges that name the year once, dates with a missing slash and spreadsheet serials are
    understood; everything but a single date leaves a flag.
    """
    def parse(raw: Column) -> Column:
        def part(pattern: str, i: int) -> Column:
            return F.regexp_extract(raw, pattern, i)

        def result(iso: Column, span: Column, flag: Column) -> Column:
            return F.struct(iso.alias("date_iso"), span.cast("int").alias("span_days"), F.array_compact(F.array(flag)).alias("flags"))

        def dated(iso: Column, flag: Column) -> Column:
            return result(iso, F.when(iso.isNotNull(), 0), F.when(iso.isNull(), "unreadable").otherwise(flag))

        none = F.lit(None).cast("string")
        single = _date(_full_year(part(_SINGLE, 3)), part(_SINGLE, 1), part(_SINGLE, 2))
        run_on = _date(_full_year(part(_RUN_ON, 3)), part(_RUN_ON, 1), part(_RUN_ON, 2))
        serial = F.date_add(F.to_date(F.lit(SERIAL_DAY_ZERO)), F.substring(raw, 1, 5).try_cast("int"))
        end_month = F.when(part(_RANGE, 3) == "", part(_RANGE, 1)).otherwise(part(_RANGE, 3))
        end_year = _full_year(part(_RANGE, 5))
        crosses = part(_RANGE, 1).try_cast("int") > end_month.try_cast("int")
        start = _date(end_year - F.when(crosses, 1).otherwise(0), part(_RANGE, 1), part(_RANGE, 2))
        end = _date(end_year, end_month, part(_RANGE, 4))
        nothing = F.lit(None).cast("date")
        return (
            F.when(raw.rlike(_SINGLE), dated(single, none))
            .when(raw == "", result(nothing, F.lit(None), F.lit("no-date")))
            .when(raw.rlike(_RANGE), result(start, F.date_diff(end, start), F.lit("range")))
            .when(raw.rlike(_RUN_ON), dated(run_on, F.lit("missing-slash")))
            .when(raw.rlike(_SERIAL), dated(serial, F.lit("serial")))
            .otherwise(result(nothing, F.lit(None), F.lit("unreadable")))
        )

    # Inside a one-element transform the struct is built once per row, however many of its fields are used.
    return F.get(F.transform(F.array(F.btrim(F.coalesce(cell, F.lit("")))), parse), F.lit(0))


def volume_mg(station: Column, volume: Column, gallon_stations: list[str]) -> Column:
    """Volume in million gallons; some stations report gallons."""
    number = F.replace(volume, F.lit(","), F.lit("")).try_cast("double")
    return F.when(station.isin(*gallon_stations), number / 1e6).otherwise(number)


def is_no_discharge(volume: Column) -> Column:
    return F.coalesce(volume, F.lit("")).rlike(r"(?i)no\s+discharge")
