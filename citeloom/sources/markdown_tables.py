"""Pipe tables inside markdown text → one row per table row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _cells(line: Column) -> Column:
    """Trimmed cells of a pipe row without its outer bars."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(" \t\r\n")), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.btrim(c, F.lit(" \t\r\n")))


def _is_separator(cells: Column) -> Column:
    filled = F.filter(cells, lambda c: c != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike("^:?-+:?$"))


def table_rows(docs: DataFrame) -> DataFrame:
    """docs(slug, text) → slug, run, row, header array<string>, cells array<string>.

    A run of pipe lines is a table from the first line that a separator row follows: that line is the header,
    the body reaches to the end of the run. Everything is decided inside the document's row, without a shuffle.
    """
    runs = docs.select("slug", F.posexplode_outer(
        F.regexp_extract_all("text", F.lit(r"(?m)(?:^[^\S\n]*\|[^\n]*(?:\n|\z))+"), F.lit(0))).alias("run", "block"))
    lines = F.transform(F.split(F.rtrim(F.col("block"), F.lit("\n")), "\n"), _cells)
    parsed = runs.filter(F.col("block").isNotNull()).select("slug", "run", lines.alias("lines"))
    marks = F.transform("lines", lambda cells, i: (i > 0) & _is_separator(cells))
    found = parsed.withColumn("at", F.array_position(marks, True).cast("int")).filter(F.col("at") > 0)
    body = F.slice("lines", F.col("at") + 1, F.size("lines"))
    rows = found.select("slug", "run", F.get("lines", F.col("at") - 2).alias("header"), F.posexplode_outer(body).alias("row", "cells"))
    return rows.filter(F.col("cells").isNotNull() & ~_is_separator(F.col("cells")))


def column_by_keyword(header: Column, cells: Column, keyword: str) -> Column:
    """Cell under the first header that contains ``keyword``; '' when there is none or the row is short."""
    at = F.array_position(F.transform(header, lambda h: F.contains(F.lower(h), F.lit(keyword))), True).cast("int")
    return F.coalesce(F.when(at > 0, F.get(cells, at - 1)), F.lit(""))
