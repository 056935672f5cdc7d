"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.llm.common import materialize, text_of, word_count

MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
HASH_RANGES = 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Words wanted from each source.

    ``sizes(source, source_size)`` has a row per source. The sources by code point, null last, take ``weights`` in turn
    and share the sum of all sizes. A target stops at ``max_repeats`` times its source's size; what it leaves is shared
    again by weight until none is above. That is the level L at which sum(min(cap, L * weight)) equals the sum: sources
    sorted by cap / weight are full up to some place, so running sums find L without iterating. The table has a row
    per source, which is why its two windows may run in one task.
    """
    every, before = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", "_place")
    place = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", place.alias("_place"), weight.alias("_weight")).withColumns({
        "_cap": F.col("source_size").cast("double") * max_repeats,
        "_ratio": F.col("source_size").cast("double") * max_repeats / F.col("_weight"),
    })
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = ranked.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("_weight").over(before.rowsBetween(0, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(all_rows).cast("double"),
    }).withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_place", "_level"))).over(all_rows)["_level"]
    return ordered.withColumn("_found", level).select(
        "source", "source_size",
        F.when(F.col("_found").isNull() | (F.col("_ratio") < F.col("_found")), F.col("_cap"))
        .otherwise(F.col("_found") * F.col("_weight")).alias("target"),
    )


def _start(source: Column, seed: int) -> Column:
    """The one random offset of a source, in [0, 1): a hash, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 40)).cast("double") / float(1 << 40)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 8) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies`` plus ``_text_key``.

    Every document of a source expects target / source size copies. Documents stand in the order of their size classes
    and, within a class, of a hash; the expected copies are summed along that order, one random offset per source is
    added, and a document is emitted once for each integer that its stretch of the sum crosses. Since neighbours in
    that order have like sizes, the words taken come near the target.

    The order is cut into (source, size class, hash range) cells. A window ranks the rows of a cell, and a table with a
    row per cell carries the counts across, so a source that holds a third of all rows is spread over many tasks.

    Nulls: a null text has size 0, a null source is a source of its own, a null id is an id like any other. Repeated
    rows are separate documents. A source without words has target 0 and none of its documents is taken. An empty table
    gives an empty result. Columns other than the three named are not read.
    """
    rows = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    return _placed(rows, rows, weights, max_repeats, seed).select("doc_id", "source", "size", "source_size", "target", "copies", "_text_key")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("_text_key"), *more)


_CELL = ("_none", "_name", "_class", "_range")


def _in_cells(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with the cell they stand in. Size classes double every eight steps; the class is only a place in the order."""
    return rows.withColumns({
        "_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit("")),
        "_class": F.floor(F.log2(F.col("size") + 1) * 8).cast("int"),
        "_hash": F.xxhash64(F.lit(seed), "doc_id", "_text_key"),
    }).withColumn("_range", F.shiftrightunsigned("_hash", 56).cast("int") % HASH_RANGES)


def _placed(rows: DataFrame, sizes: DataFrame, weights: tuple[float, ...], max_repeats: int, seed: int) -> DataFrame:
    """``rows`` with ``source_size, target, copies``; ``sizes`` are the same rows without what need not be counted.

    The shuffle that brings the rows of a cell together also brings the cell's carried count, so rows move once.
    """
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("_none", "_name").orderBy("_class", "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = _in_cells(sizes, seed).groupBy("source", *_CELL).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_s").eqNullSafe(F.col("source"))
    carried = counts.join(targets.withColumnRenamed("source", "_s"), same, "left").select(*_CELL, "_before", "source_size", "target")
    inside = Window.partitionBy(*_CELL).orderBy("size", "_hash", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    through = F.col("_before") + F.row_number().over(inside)
    placed = _in_cells(rows, seed).join(carried, list(_CELL), "left").withColumns({
        "_rate": rate, "_through": through, "_u": _start(F.col("source"), seed)})
    copies = F.floor(F.col("_through") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_through") - 1) * F.col("_rate") + F.col("_u"))
    return placed.withColumn("copies", F.least(copies.cast("bigint"), F.lit(max_repeats)))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 8) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it; columns as in ``docs``.

    Sizes are counted first; then every row travels once, to its cell, where it is ranked and emitted.
    """
    sizes = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = _placed(_sized(docs, id_col, text_col, source_col, whole), sizes, weights, max_repeats, seed).filter(F.col("copies") > 0)
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
