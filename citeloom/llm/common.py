"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citeloom.session import materialize, prepare, scratch_path

__all__ = ["BoundedCache", "TextCache", "binary_array", "let", "materialize", "prepare", "read_table", "ready", "scratch_path", "text_of",
           "word_count", "wrapped"]

# Fixed value: what the contracts take for white space between words.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: Arrow batches of a few MB, so that long texts do not fill Python workers."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1500")
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of ``folder``."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: Column | str) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def wrapped(docs: DataFrame, **extra: Column) -> DataFrame:
    """The rows of ``docs`` as one struct column ``row`` beside ``extra``, so that no name of theirs can clash;
    ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in extra.items()])


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")


class BoundedCache(dict):
    """A dict that computes missing values. When it is full its content becomes the old half, and what is asked for
    again moves back from there; at most twice ``limit`` entries are held."""

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextCache(dict):
    """A dict from texts, bounded by bytes: an entry counts 100 and ten for each character, for values of up to eight bytes
    a character. A full dict becomes the old half, as above. Keys longer than ``longest`` are computed each time."""

    def __init__(self, compute: Callable, max_bytes: int, longest: int = 1024):
        super().__init__()
        self.compute, self.max_bytes, self.longest, self.held, self.old = compute, max_bytes, longest, 0, {}

    def __missing__(self, key):
        size = len(key)
        if size > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if self.held > self.max_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += 100 + 10 * size
        self[key] = value
        return value


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def in_pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that none holds much more than ``max_bytes``; a single longer row stays whole."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * max_bytes / max(1, batch.nbytes)) or 1))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def little(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def unpack_u32(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)
