"""Keyed tables and the streams that feed them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from citeloom.sources import keyed_table as K
from citeloom.streaming import jobs as J


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_batches_hold_in_their_order_and_repeat_without_effect(spark, tmp_path):
    table, rng, want = K.KeyedTable(str(tmp_path), ("id",), buckets=4), random.Random(2), {}
    with pytest.raises(ValueError):
        K.read(spark, table)
    for batch in range(7):
        rows = {rng.randrange(40): (batch, None if rng.random() < 0.2 else f"t{batch}") for _ in range(12)}
        want |= rows
        frame = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, n int, text string")
        for _ in range(1 + batch % 2):
            K.upsert(spark, table, batch, frame)
        assert rows_of(K.read(spark, table)) == sorted(((k, *v) for k, v in want.items()), key=str)
    with pytest.raises(ValueError):
        K.upsert(spark, table, 7, spark.createDataFrame([(1, 1)], "id long, n int"))


def test_what_is_written_follows_the_batch(spark, tmp_path):
    table = K.KeyedTable(str(tmp_path), ("id",), buckets=4)
    K.upsert(spark, table, 0, spark.range(8000).withColumn("v", F.lit(0)))
    written = [K.upsert(spark, table, b, spark.range(b * 20, b * 20 + 20).withColumn("v", F.lit(b)))["written"] for b in range(1, 20)]
    assert max(written) < 900 and sum(written) < 20 * 20 * 10
    _, pieces = K._pieces(spark, table)
    assert max(map(len, pieces.values())) <= 8
    found = K.read(spark, table).groupBy("v").count()
    assert rows_of(found) == sorted([(0, 8000 - 19 * 20)] + [(b, 20) for b in range(1, 20)], key=str)


def test_order_inside_a_batch_and_null_keys(spark, tmp_path):
    table = K.KeyedTable(str(tmp_path), ("id",))
    rows = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (None, "n", 5), (None, "m", 6)], "id long, text string, came int")
    K.upsert(spark, table, 0, rows, "came")
    assert rows_of(K.read(spark, table)) == sorted([(1, "a"), (None, "m")], key=str)
    with pytest.raises(ValueError):
        K.upsert(spark, table, 1, rows.drop("came"))
    assert rows_of(K.read(spark, table)) == sorted([(1, "a"), (None, "m")], key=str)  # the failed batch is not seen


def test_sums_and_empty_batches(spark, tmp_path):
    table = K.KeyedTable(str(tmp_path), ("k",), ("n",), buckets=2)
    empty = spark.createDataFrame([], "k string, n long")
    K.upsert(spark, table, 0, empty)
    assert K.read(spark, table).count() == 0
    for batch, repeat in ((1, 2), (2, 1), (3, 3)):
        for _ in range(repeat):
            K.upsert(spark, table, batch, spark.createDataFrame([("a", 1), ("a", 2), ("b", batch)], "k string, n long"))
    K.upsert(spark, table, 4, empty)
    assert rows_of(K.read(spark, table)) == [("a", 9), ("b", 6)]


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_a_copy_after_the_horizon_is_dropped(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "event_id bigint, ts timestamp, v int"
    runs = [
        [(1, at(1), 0), (1, at(1), 1), (2, at(1, 5), 0)],
        [(3, at(20), 0), (1, at(1), 2)],               # a copy 19 days late, its state gone
        [(2, at(1, 5), 3), (4, at(1, 6), 0), (3, at(20), 9), (5, at(21), 0)],  # a late event that is new stays
    ]
    for run in runs:
        spark.createDataFrame(run, schema).coalesce(1).write.mode("append").parquet(source)
        J.dedupe_to_table(J.read_stream(spark, source, schema), target, mark, horizon="12 hours", keep_ms=1).awaitTermination()
    assert rows_of(spark.read.parquet(target).select("event_id", "v").filter("event_id <> 3")) == [(1, 0), (2, 0), (4, 0), (5, 0)]


def test_state_drops_copies_while_it_lives(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "event_id bigint, ts timestamp"
    for run in ([(1, at(1)), (2, at(1))], [(2, at(1)), (1, at(1)), (3, at(1))]):
        spark.createDataFrame(run, schema).coalesce(1).write.mode("append").parquet(source)
        J.dedupe_to_table(J.read_stream(spark, source, schema), target, mark).awaitTermination()
    assert rows_of(spark.read.parquet(target).select("event_id")) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_ids_share_a_state_by_groups(spark, tmp_path, kind):
    """Many ids in two groups of state, their copies in one batch and in later ones; the earliest copy stays."""
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [((1 << 60) + i, at(1 + i % 3, 5), "late") for i in range(40)] + [((1 << 60) + i, at(1 + i % 3), "early") for i in range(40)]
    for run in (rows + [(None, at(1), "early"), (None, at(1, 2), "late")], [(i, t, "again") for i, t, _ in rows] + [(7, at(2), "early")]):
        docs = spark.createDataFrame(run, "event_id bigint, ts timestamp, v string").withColumn("event_id", F.col("event_id").cast(kind))
        docs.coalesce(1).write.mode("append").parquet(source)
        stream = J.read_stream(spark, source, f"event_id {kind}, ts timestamp, v string")
        J.dedupe_to_table(stream, target, mark, groups=2).awaitTermination()
    kept = spark.read.parquet(target).select(F.col("event_id").cast("bigint"), "v").collect()
    assert len(kept) == 42 and {r["v"] for r in kept} == {"early"}
    assert {r["event_id"] for r in kept} == {None, 7, *((1 << 60) + i for i in range(40))}


def test_the_last_to_arrive_holds(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, 9), (1, 5), (2, 1)], [(2, 0)]):
        spark.createDataFrame(rows, "id bigint, label int").coalesce(1).write.mode("append").parquet(source)
    job, table = J.upsert_stream(J.read_stream(spark, source, "id bigint, label int"), str(tmp_path / "t"), str(tmp_path / "mark"))
    job.awaitTermination()
    assert rows_of(K.read(spark, table)) == [(1, 5), (2, 0)]


def test_late_rows_count(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "station string, ts timestamp, volume double"
    for run in ([("a", at(28), 1.0), ("a", at(1), 2.0)], [("a", at(1, 3), 4.0), ("b", at(2), None)]):
        spark.createDataFrame(run, schema).coalesce(1).write.mode("append").parquet(source)
        job, table = J.rollup_stream(J.read_stream(spark, source, schema), str(tmp_path / "t"), str(tmp_path / "mark"))
        job.awaitTermination()
    assert rows_of(K.read(spark, table)) == sorted([("a", at(1), 2, 6.0), ("a", at(28), 1, 1.0), ("b", at(2), 1, None)], key=str)
