"""A table of rows by key that takes in numbered batches; what a batch writes follows the batch, not the table.

Rows lie in buckets by key. A batch adds one piece per bucket that it touches; pieces that are no longer than twice what
comes after them are taken into the new piece, so a bucket has few pieces and a row is rewritten a logarithmic number of
times. A commit, written last, lists the pieces of all buckets. A batch that is repeated starts again from the commit before
it: it replaces itself, and a batch that failed half-way leaves only files that no commit names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
_COMMIT = "batch bigint, buckets int, schema string, bucket int, place int, folder string, rows bigint"


@dataclass(frozen=True)
class KeyedTable:
    """``keys`` tell rows apart. Of rows with one key the last holds, or, for ``sums``, those columns are added up."""

    root: str
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    buckets: int = BUCKETS


def _commits(spark: SparkSession, table: KeyedTable) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{table.root}/commits").select(*[f.name for f in T._parse_datatype_string(_COMMIT)])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _pieces(spark: SparkSession, table: KeyedTable, before: int | None = None) -> tuple[str | None, dict[int, list[tuple[str, int]]]]:
    """Schema and pieces (folder, rows) per bucket of the last commit, or of the last one before a batch."""
    commits = _commits(spark, table)
    if commits is None:
        return None, {}
    if before is not None:
        commits = commits.filter(F.col("batch") < before)
    last = commits.agg(F.max("batch")).first()[0]
    found, schema = {}, None
    for r in sorted(commits.filter(F.col("batch") == last).collect(), key=lambda r: r["place"]) if last is not None else ():
        schema = r["schema"]
        found.setdefault(r["bucket"], []).append((r["folder"], r["rows"]))
    return schema, found


def _one_per_key(rows: DataFrame, table: KeyedTable, order: Column) -> DataFrame:
    """Keys compare null-safe, as groups do."""
    others = [c for c in rows.columns if c not in table.keys]
    if table.sums:
        return rows.groupBy(*table.keys).agg(*[(F.sum(c) if c in table.sums else F.max_by(c, order)).alias(c) for c in others]).select(*rows.columns)
    last = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return last.select(*table.keys, "_last.*").select(*rows.columns)


def _read(spark: SparkSession, table: KeyedTable, schema: str, pieces: list[tuple[int, str]]) -> DataFrame:
    return spark.read.schema(f"{schema}, _batch bigint").parquet(*[f"{table.root}/data/{folder}/bucket={b}" for b, folder in pieces])


def _write(spark: SparkSession, rows: DataFrame, table: KeyedTable, batch: int) -> tuple[str, dict[int, int]]:
    folder = f"b{batch:08d}-{uuid.uuid4().hex[:12]}"
    bucket = F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")
    path = f"{table.root}/data/{folder}"
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
    written = spark.read.schema("bucket int").parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    return folder, {r["bucket"]: r["n"] for r in written}


def upsert(spark: SparkSession, table: KeyedTable, batch: int, rows: DataFrame, order: str | None = None) -> dict[str, int]:
    """Take in ``rows`` as batch ``batch``; batches are numbered in the order in which they hold. Of rows with one key in
    the batch the last by ``order`` holds, which is not stored; without ``order`` keys must not repeat, unless rows are
    summed. Returns rows given and rows written."""
    stored = rows.drop(order) if order else rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    if order or table.sums:
        ranked = _one_per_key(rows, table, F.col(order) if order else F.lit(0))
        fresh = ranked.drop(order) if order else ranked
    else:
        fresh = stored
    known, pieces = _pieces(spark, table, before=batch)
    if known is not None and known != schema:
        raise ValueError(f"batch has columns {schema}, the table {known}")
    folder, counts = _write(spark, fresh.withColumn("_batch", F.lit(batch).cast("bigint")), table, batch)
    if not order and not table.sums:
        twice = _read(spark, table, schema, [(b, folder) for b in counts]).groupBy(*table.keys).count().filter("count > 1") if counts else None
        if twice is not None and not twice.isEmpty():
            raise ValueError("a key repeats within the batch and no order was given")
    absorbed: list[tuple[int, str]] = []
    for b, n in counts.items():
        own, total = pieces.setdefault(b, []), n
        while own and own[-1][1] <= 2 * total:
            older, size = own.pop()
            absorbed.append((b, older))
            total += size
        own.append((folder, n))
    written = sum(counts.values())
    if absorbed:
        grown = {b for b, _ in absorbed}
        both = _read(spark, table, schema, absorbed + [(b, folder) for b in grown])
        merged, sizes = _write(spark, _one_per_key(both, table, F.col("_batch")), table, batch)
        written += sum(sizes.values())
        for b in grown:
            pieces[b][-1] = (merged, sizes[b])
    listed = [(batch, table.buckets, schema, b, i, f, n) for b, own in pieces.items() for i, (f, n) in enumerate(own)]
    empty = [(batch, table.buckets, schema, -1, 0, "", 0)]  # a commit of a table without rows
    spark.createDataFrame(listed or empty, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{table.root}/commits/c={batch:08d}")
    return {"given": sum(counts.values()), "written": written}


def read(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The table's rows; an error if no batch was taken in."""
    schema, pieces = _pieces(spark, table)
    if schema is None:
        raise ValueError(f"no batch in {table.root}")
    places = [(b, folder) for b, own in pieces.items() for folder, _ in own if b >= 0]
    if not places:
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return _one_per_key(_read(spark, table, schema, places), table, F.col("_batch")).drop("_batch")
