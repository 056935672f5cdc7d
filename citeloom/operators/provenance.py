"""Tiered provenance of files: ledger index, match, companion inheritance, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citeloom.functions.provenance import (
    basename, canonical_url, clean_title, file_tokens, first_url, humanize, stem, url_tier,
)
from citeloom.operators.chunking import first_wins
from citeloom.sources.markdown_tables import column_by_keyword


def ledger_entries(rows: DataFrame) -> DataFrame:
    """Table rows(slug, run, row, header, cells) → one entry per file name they mention.

    kind 'p' = named in the file column, 's' = named in the note column.
    """
    def cell(keyword: str):
        return column_by_keyword(F.col("header"), F.col("cells"), keyword)

    base = rows.select(
        F.col("slug").alias("ledger"), "run", "row", clean_title(cell("title")).alias("title"), first_url(cell("url")).alias("url"),
        F.array(
            F.struct(F.lit("p").alias("kind"), file_tokens(cell("file")).alias("names")),
            F.struct(F.lit("s").alias("kind"), file_tokens(cell("note")).alias("names")),
        ).alias("found"),
    )
    kinds = base.select("ledger", "run", "row", "title", "url", F.explode("found").alias("f"))
    return kinds.select("ledger", "run", "row", "title", "url", "f.kind", F.posexplode("f.names").alias("pos", "basename"))


def ledger_index(entries: DataFrame) -> DataFrame:
    """First entry per (kind, file name): ledgers by name, then row order."""
    return first_wins(entries, ["kind", "basename"], ["ledger", "run", "row", "pos"]).select(
        "kind", "basename", "title", "url", "ledger")


def match(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(folder, file) → title, url, tier: the file-column entry of the name, else its note-column entry.

    The index is brought to one row per name first, so one equi-join decides both tiers.
    """
    names = index.groupBy("basename").agg(
        F.min_by(F.struct("title", "url", F.col("kind").alias("tier")), "kind").alias("m")
    )
    return files.withColumn("basename", basename(F.col("file"))).join(names, "basename", "left").select(
        "folder", "file", "m.title", "m.url", "m.tier")


def inherit(matched: DataFrame) -> DataFrame:
    """Unmatched files take title and url of the first same-stem file of their folder that has a title.

    Donors are one aggregated row per (folder, stem), so the join back never multiplies rows.
    """
    rows = matched.withColumn("stem", stem(F.col("file")))
    donors = rows.filter(F.coalesce("title", F.lit("")) != "").groupBy("folder", "stem").agg(
        F.min_by(F.struct("title", "url"), "file").alias("d"))
    takes = F.col("tier").isNull() & F.col("d").isNotNull()
    return rows.join(donors, ["folder", "stem"], "left").select(
        "folder", "file", F.when(takes, F.col("d.title")).otherwise(F.col("title")).alias("title"),
        F.when(takes, F.col("d.url")).otherwise(F.col("url")).alias("url"),
        F.when(takes, "c").otherwise(F.col("tier")).alias("tier"))


def manifest(files: DataFrame, index: DataFrame) -> DataFrame:
    """Every file with title (its humanised name when none is known), url and tier."""
    rows = inherit(match(files, index))
    known = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    return rows.withColumn("title", F.coalesce(known, humanize(basename(F.col("file")))))


def match_stats(rows: DataFrame) -> DataFrame:
    """Files and matches per folder plus a total row (folder null), with the matched share in percent."""
    def tier(kind: str):
        return F.count_if(F.col("tier") == kind)

    n = F.count(F.lit(1))
    return rows.rollup("folder").agg(
        n.alias("files"), tier("p").alias("p"), tier("s").alias("s"), tier("c").alias("c"),
        F.count_if(F.col("tier").isNull()).alias("unmatched"), F.grouping("folder").cast("int").alias("is_total"),
        F.round(F.count_if(F.col("tier").isNotNull()) * 100.0 / n, 1).alias("percent"),
    )


def unmatched(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files no ledger names."""
    return files.withColumn("basename", basename(F.col("file"))).join(
        index.select("basename"), "basename", "left_anti").select("folder", "file")


def cited_in(citations: DataFrame) -> DataFrame:
    """citations(url, doc) → a row per work and document that cites it: key, tier, doc. A work is never one long row."""
    keyed = citations.select(canonical_url(F.col("url")).alias("key"), url_tier(F.col("url")).alias("tier"), "doc")
    return keyed.groupBy("key", "doc").agg(F.min("tier").alias("tier")).select("key", "tier", "doc")


def citing_counts(citations: DataFrame) -> DataFrame:
    """citations(url, doc) → how many documents cite each work: key, tier, n_docs."""
    return cited_in(citations).groupBy("key").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("n_docs"))
