"""Structured Streaming forms of the incremental jobs. Checkpoints take the place of done-logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from citeloom.operators.chunking import chunk_documents
from citeloom.session import materialize
from citeloom.sources.keyed_table import KeyedTable, upsert


def read_stream(spark: SparkSession, folder: str, ddl: str, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def ingest_chunks(documents: DataFrame) -> DataFrame:
    """Stream of documents(file, text) → stream of passages. Chunking keeps no state between documents."""
    return chunk_documents(documents)


def dedupe_by_id(events: DataFrame, key: str = "event_id", time: str = "ts", horizon: str = "1 day") -> DataFrame:
    """First copy of each id within the watermark; state is dropped when the watermark passes."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


#: Groups of ids whose state is kept together: a look-up of the state per group and batch, not one per id.
ID_GROUPS = 4096


class _FirstCopies(StatefulProcessor):
    """Hands on the earliest row of each id of a group that the group's state does not know. The state is a list of ids with the
    time at which each was last seen; an id leaves it after ``keep_ms``."""

    def __init__(self, key: str, kind: str, time: str, keep_ms: int):
        self.key, self.kind, self.time, self.keep_ms = key, kind, time, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", f"ids array<{self.kind}>, at array<bigint>", self.keep_ms)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        firsts = [r.sort_values(self.time, kind="stable").drop_duplicates(self.key) for r in rows]
        first = pd.concat(firsts).sort_values(self.time, kind="stable").drop_duplicates(self.key)
        now, known = timers.getCurrentProcessingTimeInMs(), {}
        if self.seen.exists():
            ids, at = self.seen.get()
            known = {i: t for i, t in zip(ids, at) if t + self.keep_ms > now}
        own = [None if pd.isna(i) else i for i in first[self.key].tolist()]
        fresh = first[[i not in known for i in own]]
        known.update(dict.fromkeys(own, now))
        self.seen.update((list(known), list(known.values())))
        if len(fresh):
            yield fresh.drop(columns="_group", errors="ignore")

    def close(self) -> None:
        pass


def dedupe_to_table(events: DataFrame, target: str, checkpoint: str, key: str = "event_id", time: str = "ts",
                    horizon: str = "1 day", keep_ms: int = 172_800_000, groups: int = ID_GROUPS) -> StreamingQuery:
    """One row of each id in a table below ``target``, however late its copies come; copies carry the time of their event.

    Keyed state, kept in the state store on disk for groups of ids, drops copies for ``keep_ms`` after an id was last seen; no
    watermark hides a late row. Rows at least ``horizon`` older than the newest of their batch may be copies of ids whose state has ended: they
    are looked up in the written table, in the days of their own events alone. A batch writes a folder of its own, so a
    repeated batch replaces itself.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.withColumn("day", F.to_date(time)), "first-copies")
        newest = rows.agg((F.max(time) - F.expr(f"INTERVAL {horizon}")).alias("t")).first()["t"]
        old = rows.filter(F.col(time) <= F.lit(newest)) if newest is not None else rows.limit(0)
        days = [r[0] for r in old.select("day").distinct().collect()]
        try:
            written = spark.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}, batch bigint, day date").parquet(target)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            written = None
        if days and written is not None:
            before = written.filter(F.col("day").isin(days) & (F.col("batch") != batch_id)).select(key)
            known = old.join(before, key, "left_semi").select(key)
            rows = rows.join(known, key, "left_anti")
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch={batch_id}")

    processor = _FirstCopies(key, events.schema[key].dataType.simpleString(), time, keep_ms)
    # null ids are a group of their own, so that they turn no other ids of a frame into floats
    grouped = events.withColumn("_group", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups)))).groupBy("_group")
    firsts = grouped.transformWithStateInPandas(processor, events.schema, "Append", "ProcessingTime")
    # a time to live would have Spark start batches without data again and again, which a run over what is there never ends
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return firsts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rollup_stream(events: DataFrame, root: str, checkpoint: str, time: str = "ts") -> tuple[StreamingQuery, KeyedTable]:
    """Events and volume per station and day. Every micro-batch adds its own sums to a keyed table, so a row counts however
    late it comes, nothing is held in memory, and a repeated batch counts once."""
    table = KeyedTable(root, ("station", "start"), ("events", "volume"))

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("station", F.date_trunc("day", time).alias("start")).agg(
            F.count(F.lit(1)).alias("events"), F.sum("volume").alias("volume"))
        upsert(batch.sparkSession, table, batch_id, sums)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), table


def write_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet until all available input is processed."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def arrivals(stream: DataFrame) -> DataFrame:
    """Rows of a file stream with their place of arrival (``_arrived``): time of the file, its name, place inside it."""
    return stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index").alias("_arrived"))


def upsert_stream(rows: DataFrame, root: str, checkpoint: str, key: str = "id") -> tuple[StreamingQuery, KeyedTable]:
    """Each micro-batch of a file stream is a batch of a keyed table: repeating it changes nothing, and of rows with one key the one that arrived last holds."""
    table = KeyedTable(root, (key,))

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, table, batch_id, batch, "_arrived")

    return arrivals(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), table
