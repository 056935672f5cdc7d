"""Figure pages: candidate heuristic, work order, description records, figure passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.ids import figure_id
from citeloom.functions.text import FIGURE_WORDS, figure_text, squeeze_space, strip_space

# Page lengths below which a captioned or any page is a candidate, least description length.
CAPTION_BELOW, SPARSE_BELOW, LEAST_DESCRIPTION = 1200, 300, 40


def figure_candidates(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pages of finished PDFs that name a figure and are short, or hold almost no text."""
    pdf = pages.filter(F.lower("file").endswith(".pdf"))
    if done is not None:
        pdf = pdf.join(done.select("file"), "file", "left_semi")
    text = strip_space(F.coalesce("text", F.lit("")))
    captioned = text.rlike(FIGURE_WORDS) & (F.length(text) < CAPTION_BELOW)
    why = F.when(captioned, "caption").when(F.length(text) < SPARSE_BELOW, "sparse")
    return pdf.select(
        figure_id(F.col("file"), F.col("page")).alias("id"), "file", "page", why.alias("why"),
        F.substring(strip_space(squeeze_space(text)), 1, 160).alias("ocr_snippet"),
    ).filter(F.col("why").isNotNull())


def work_order(candidates: DataFrame, order: list[str], cap: int | None = None, pattern: str | None = None) -> DataFrame:
    """Captioned pages first, then input order; optional path pattern and cap."""
    rows = candidates.filter(F.col("file").rlike(pattern)) if pattern else candidates
    rows = rows.orderBy(F.when(F.col("why") == "caption", 0).otherwise(1), *order)
    return rows.limit(cap) if cap else rows


def description_status(description: Column) -> Column:
    """Outcome of one described page."""
    skip = F.upper(strip_space(description)).startswith("SKIP") | (F.length(description) < LEAST_DESCRIPTION)
    return F.when(description.isNull(), "error").when(skip, "skip").otherwise("figure")


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Passages of kept figures(id, file, page, status, description)."""
    return figures.filter(F.col("status") == "figure").select(
        "id", "file", F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        figure_text(F.col("file"), F.col("page"), F.col("description")).alias("text"),
    )
