import base64
import hashlib

import zstandard
from pyspark.sql import functions as F

from citeloom.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip_of_a_table(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder, index = warc.write_archive(pages.repartition(3), str(tmp_path))
    want = {r.page_id: (r.url, r.html or "") for r in pages.collect()}
    rows = {r.page_id: r for r in warc.read_archive(folder, index).collect()}
    assert rows.keys() == want.keys()
    for i, (url, html) in want.items():
        r = rows[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(html.encode()), digest(html.encode()))
        assert r.record_type == "revisit" or r.payload == html.encode()


def test_equal_payloads_and_edges(spark, tmp_path):
    rows = [(9, "u://a", "same"), (3, None, "same"), (5, "u:// \n%0A", "same"), (1, "", None), (2, "u", ""), (None, "n", "same"), (None, None, None),
            (7, "big", "z" * 1_000_000), (8, "big", "z" * 1_000_000), (4, "own", "only"), (3, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("_digest", F.lit(1))
    folder, index = warc.write_archive(pages, str(tmp_path))
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.url) for r in warc.read_archive(folder, index).collect()), key=str)
    assert found == sorted([
        (9, "revisit", 3, 4, "u://a"), (3, "response", None, 4, None), (3, "response", None, 4, None), (5, "revisit", 3, 4, "u:// \n%0A"),
        (1, "response", None, 0, ""), (2, "revisit", 1, 0, "u"), (None, "revisit", 3, 4, "n"), (None, "revisit", 1, 0, None),
        (7, "response", None, 1_000_000, "big"), (8, "revisit", 7, 1_000_000, "big"), (4, "response", None, 4, "own")], key=str)
    got = warc.fetch(folder, index, spark.createDataFrame([(4,), (7,)], "page_id long")).collect()
    assert {(r.page_id, len(r.payload)) for r in got} == {(4, 4), (7, 1_000_000)}
    none = pages.limit(0)
    folder, index = warc.write_archive(none, str(tmp_path / "none"))
    assert warc.read_archive(folder, index).count() == 0


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    folder, index = warc.write_archive(pages, str(tmp_path), least_bytes=5)
    assert {r.page_id: r.refers_to for r in warc.read_archive(folder, index).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_frames_stand_alone_and_the_whole_is_plain_zstandard(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    writer = warc.BundleWriter(str(tmp_path), "t")
    records = [warc.write_record(i, f"u://{i}", bytes([i]) * 700, None, False) for i in range(20)]
    for i, record in enumerate(records):
        writer.add(i, record)
    writer.close()
    index = writer.taken()
    reader = warc.BundleReader(str(tmp_path), index[0][1])
    assert len(reader.frames) > 3
    for page_id, _, frame, start, size, offset, length in reversed(index):
        assert reader.frames[frame][:2] == (start, size)
        assert reader.frame(frame)[offset:offset + length] == records[page_id]
    with open(tmp_path / index[0][1], "rb") as file:
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(records)
