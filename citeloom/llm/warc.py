"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import in_pieces, materialize, scratch_path

FRAME_BYTES = 256 << 10    # uncompressed bytes after which a frame is closed; a longer record has a frame of its own
BUNDLE_BYTES = 32 << 20    # compressed bytes after which a bundle is closed
LEVEL = 3

# Fixed values of the seekable format: magic numbers, the descriptor without checksums.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

INDEX = "page_id bigint, bundle string, frame int, frame_start bigint, frame_size bigint, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
CRLF = b"\r\n"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share, in any scheme that Arrow knows."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _one_line(text: str) -> str:
    """A header value: line breaks and the escape mark itself are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool,
                 digest: str | None = None) -> bytes:
    """One WARC record. A revisit leaves the payload out; its HTTP head still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest or digest_of(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + CRLF * 2 + block + CRLF * 2


def read_record(data: bytes) -> dict:
    """The record that ``data`` holds."""
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    size = int(dict(line.split(b": ", 1) for line in http.split(CRLF)[1:])[b"Content-Length"])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != _urn(None) else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To", "")),
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


class BundleWriter:
    """Bundles in one folder: independent frames of whole records, then a skippable frame with the seek table.

    A bundle's name is unique to the task attempt, and a reader knows bundles only from the index, which Spark commits.
    A repeated attempt writes other bundles, so a lost executor leaves at most files that no index names.
    """

    def __init__(self, folder: str, prefix: str):
        self.uri, self.prefix = folder, prefix
        self.store, self.path = open_store(folder)
        self.store.create_dir(self.path, recursive=True)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.bundles, self.index = None, 0, []
        self._fresh()

    def _fresh(self) -> None:
        self.table: list[tuple[int, int]] = []
        self.at, self.pending, self.pending_size = 0, [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.prefix}-{self.bundles:05d}.warc.zst"
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.bundles += 1
        self.pending.append((page_id, record))
        self.pending_size += len(record)
        if self.pending_size >= FRAME_BYTES:
            self._close_frame()
            if self.at >= BUNDLE_BYTES:
                self.close()

    def _close_frame(self) -> None:
        if not self.pending:
            return
        data = b"".join(r for _, r in self.pending)
        packed = self.compressor.compress(data)
        self.out.write(packed)
        offset = 0
        for page_id, record in self.pending:
            self.index.append((page_id, self.name, len(self.table), self.at, len(packed), offset, len(record)))
            offset += len(record)
        self.table.append((len(packed), len(data)))
        self.at += len(packed)
        self.pending, self.pending_size = [], 0

    def close(self) -> None:
        """Finish the open bundle."""
        if self.out is None:
            return
        self._close_frame()
        entries = b"".join(ENTRY.pack(*e) for e in self.table) + FOOTER.pack(len(self.table), DESCRIPTOR, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()
        self.out = None
        self._fresh()

    def taken(self) -> list[tuple]:
        rows, self.index = self.index, []
        return rows


class BundleReader:
    """Random access to a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        store, path = open_store(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        frames, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(frames * ENTRY.size, size - FOOTER.size - frames * ENTRY.size)
        self.frames, at = [], 0
        for packed, data in ENTRY.iter_unpack(table):
            self.frames.append((at, packed, data))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, data = self.frames[number]
        return self.decompressor.decompress(self.file.read_at(packed, at), max_output_size=data)

    def close(self) -> None:
        self.file.close()


def first_holders(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``_digest, _first``: for each payload of at least ``least_bytes`` that occurs more than once, its smallest page.

    Counts and minima are combined before the shuffle, so a payload that fills a third of the table is one row per task.
    """
    return pages.filter(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(
        F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_first")


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write a record per page; returns the folder and the index ``page_id, bundle, frame, frame_start, frame_size,
    offset, length`` (offset and length inside the frame's data).

    Of equal payloads of at least ``least_bytes`` the page with the smallest id is a response and the others revisit it.
    Small digest rows find the first holders; pages then join them by digest, a join that adaptive execution splits
    where one payload is very frequent, and every task writes bundles of its own.

    A null payload is empty. A null id is written without a number; it is smaller than no other id. Rows repeated with
    the smallest id are all responses. A null url has no header. An empty table writes nothing and gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({
        "_digest": F.unhex(F.sha1("payload")), "_bytes": F.octet_length("payload").cast("bigint")})
    firsts = materialize(first_holders(rows.select("page_id", "_digest", "_bytes"), least_bytes), "warc-firsts")
    joined = rows.join(firsts, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left").select(
        "page_id", "url", "payload", "_digest", "_first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:16]}")
        names = ["page_id", "bundle", "frame", "frame_start", "frame_size", "offset", "length"]
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]

        def indexed() -> Iterator[pa.RecordBatch]:
            found = writer.taken()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        for batch in in_pieces(batches):
            for page_id, url, data, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = first is not None and page_id != first
                writer.add(page_id, write_record(page_id, url, data, first, revisit, base64.b32encode(digest).decode("ascii")))
            yield from indexed()
        writer.close()
        yield from indexed()

    return folder, materialize(joined.mapInArrow(write, INDEX), "warc-index")


def _read(located: DataFrame, folder: str) -> DataFrame:
    """Records at the places of ``located``, whose rows of a bundle and frame stand together."""
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, reader, number, data, out, size = None, None, None, b"", [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for name, frame, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name != bundle:
                    if reader:
                        reader.close()
                    bundle, reader, number = name, BundleReader(folder, name), None
                if frame != number:
                    number, data = frame, reader.frame(frame)
                out.append(read_record(data[offset:offset + length]))
                size += length
                if size > 8 << 20:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()
        if reader:
            reader.close()

    return located.select("bundle", "frame", "offset", "length").mapInArrow(read, RECORDS)


def read_archive(folder: str, index: DataFrame) -> DataFrame:
    """All records: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Frames are read one by one, each once, and dealt to tasks by bundle and frame.
    """
    return _read(index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset"), folder)


def fetch(folder: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the pages in ``wanted(page_id)``; only the frames that hold one are read."""
    return read_archive(folder, index.join(wanted.select("page_id").distinct(), "page_id", "left_semi"))
