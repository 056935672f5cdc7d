"""Writers. Every sink is a plain parquet or JSON folder that can be rewritten after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_log(records: DataFrame, folder: str) -> None:
    """Append result records as JSON lines."""
    records.write.mode("append").json(folder)


def overwrite_chunks(chunks: DataFrame, folder: str, origins: tuple[str, ...] = ()) -> None:
    """Rebuild only the origins present in ``chunks`` (docs, source, figure), and those named in ``origins``; others stay.

    So a text rebuild keeps figure passages, which a plain overwrite would lose. A named origin that ``chunks`` has no
    row of is emptied: writing rows cannot say that, so its partition is removed.
    """
    if origins:
        spark, found = chunks.sparkSession, {r[0] for r in chunks.select("origin").distinct().collect()}
        for origin in sorted(set(origins) - found):
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/origin={origin}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(folder)


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows of ``current`` with the same key."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_version(spark: SparkSession, root: str, version: int, new: DataFrame, key: str = "id") -> str:
    """Write version ``version`` of a table as the previous one upserted with ``new``.

    Writing the same version again gives the same folder, so a retried batch changes nothing.
    """
    target = f"{root}/v={version:08d}"
    rows = new if version == 0 else upsert(spark.read.parquet(f"{root}/v={version - 1:08d}"), new, key)
    rows.write.mode("overwrite").parquet(target)
    return target


def write_search_records(sections: DataFrame, folder: str) -> None:
    """Section records as sharded JSON."""
    sections.write.mode("overwrite").json(folder)


def write_layers(layers: DataFrame, folder: str) -> None:
    """Merged features, one partition per layer."""
    layers.write.mode("overwrite").partitionBy("layer").parquet(folder)


def write_manifest(rows: DataFrame, folder: str) -> None:
    """Manifest rows as rendered by ``manifest_cells``, one partition per folder."""
    rows.write.mode("overwrite").partitionBy("folder").parquet(folder)


def manifest_cells(rows: DataFrame) -> DataFrame:
    """Display cells of manifest rows(folder, file, title, url): bars escaped, a dash when there is no URL."""
    return rows.select(
        "folder", F.concat(F.lit("`"), "file", F.lit("`")).alias("file_cell"),
        F.replace("title", F.lit("|"), F.lit("\\|")).alias("title_cell"),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("<"), "url", F.lit(">"))).otherwise("—").alias("url_cell"),
    )
