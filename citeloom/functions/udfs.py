"""User functions: the full entity table, and the chunker for SQL users."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from citeloom.functions.text import strip_markup, tidy_plain, unescape_named


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    """Resolve every entity. Python gets the text only of rows with an ampersand the JVM list does not cover, else null."""
    others = F.regexp_replace(text, r"&(lt|gt|quot|apos|#39|nbsp|copy|middot|mdash|ndash|hellip|amp);", "")
    rest = F.when(F.contains(others, F.lit("&")), text)
    return F.coalesce(_unescape(rest), unescape_named(text))


def html_to_text(html_text: Column) -> Column:
    """Readable text of a web page."""
    return tidy_plain(unescape_html(strip_markup(html_text)))


@F.arrow_udtf(returnType="file string, n int, page_start int, page_end int, text string")
class ChunkText:
    """Chunker over a table of pages, batches in and batches out:
    ``SELECT * FROM chunk_text(TABLE(SELECT file, page, text FROM pages) PARTITION BY file ORDER BY page)``.

    Blank pages are dropped and blanks squeezed, as everywhere. A window is kept from batch to batch and ends with its file.
    """

    def __init__(self):
        self.window = None

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        from citeloom.operators.chunking import Window, tidy_line

        rows = []
        for file, page, text in zip(*(pages.column(c).to_pylist() for c in ("file", "page", "text"))):
            if self.window is None or self.window.file != file:
                rows += list(self.window.finish()) if self.window else []
                self.window = Window(file)
            line = tidy_line(text)
            if line:
                rows += self.window.add(page, line)
        if rows:
            yield self._table(rows)

    def terminate(self) -> Iterator[pa.Table]:
        rows = list(self.window.finish()) if self.window else []
        if rows:
            yield self._table(rows)

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows))[:5]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "n", "page_start", "page_end", "text"])


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("unescape_html", _unescape)
