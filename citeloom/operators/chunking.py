"""Documents → overlapping, page-anchored passages."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.ids import chunk_id
from citeloom.functions.text import WHITESPACE, squeeze_blanks
from citeloom.operators.ordered import last_known, running_sum_before
from citeloom.session import materialize

# Passage length, overlap.
TARGET, OVERLAP = 2800, 400
PAGE_GAP = "\n\n"
_BLOCK = 8192  # long pages enter the window in pieces of this size, so each step copies a bounded string
_BLANKS = re.compile("[ \\t]+")
_SPACE_CODES = np.array([ord(c) for c in WHITESPACE], np.uint32)

TASK_CHARS = 16 << 20  # characters of pages that one task sorts
LONG = 4 << 20      # characters of a file beyond which it is cut by several tasks

_CHUNK_FIELDS = "page_start int, page_end int, text string, start_at bigint, end_at bigint"


def tidy_pages(pages: DataFrame) -> DataFrame:
    """Collapse blanks inside page text, drop pages that are empty afterwards."""
    return pages.withColumn("text", squeeze_blanks(F.col("text"))).filter(F.length("text") > 0)


def chunk_documents(docs: DataFrame, long: int = LONG) -> DataFrame:
    """docs(file, text), a line being a page → passages. No shuffle: each document is cut where it is; one of more than
    ``long`` characters is cut by several tasks, unless it comes in a stream.

    A JVM fold (``aggregate`` over pages) gives the same rows but measured three times slower than this
    Arrow-batched cut, because the fold is interpreted and rebuilds its state struct for every page.
    """
    whole = docs.select("file", "text")
    short = whole if docs.isStreaming else whole.filter(F.coalesce(F.length("text"), F.lit(0)) <= long)
    out = _with_ids(short.mapInArrow(_document_batches, f"file string, n int, {_CHUNK_FIELDS}"))
    if docs.isStreaming:
        return out
    giants = docs.filter(F.length("text") > long)
    if giants.isEmpty():
        return out
    pages = giants.select("file", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return out.unionByName(_with_ids(cut_in_parallel(pages)))


def chunk_pages(pages: DataFrame, long: int = LONG) -> DataFrame:
    """pages(file, page, text) → passages.

    Pages of a file of up to ``long`` characters are brought together, sorted, and read as a stream that holds one window
    at a time. Longer files are cut by several tasks each.
    """
    sizes = pages.groupBy("file").agg(F.sum(F.length("text") + len(PAGE_GAP)).alias("size"))
    sizes = materialize(sizes, "file-sizes")
    giants = sizes.filter(F.col("size") > long).select("file")
    some, chars = sizes.agg(F.coalesce(F.max(F.col("size") > long), F.lit(False)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = tidy_pages(pages.join(giants, "file", "left_anti") if some else pages).select("file", F.col("page").cast("int").alias("page"), "text")
    # as many tasks as the pages need, so that what one sorts does not grow with the table
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / TASK_CHARS))
    rows = rows.repartition(tasks, "file").sortWithinPartitions("file", "page")
    out = _with_ids(rows.mapInArrow(_page_batches, f"file string, n int, {_CHUNK_FIELDS}"))
    return out.unionByName(_with_ids(cut_in_parallel(pages.join(giants, "file", "left_semi")))) if some else out


def _with_ids(cut: DataFrame) -> DataFrame:
    """Ids count only emitted passages."""
    return cut.select("file", "n", chunk_id(F.col("file"), F.col("n")).alias("id"),
                      "page_start", "page_end", "text", "start_at", "end_at")


class Window:
    """Text not yet emitted of the file being read."""

    def __init__(self, file: str):
        self.file, self.buf, self.at, self.end, self.n = file, "", 0, 0, 0
        self.marks: list[tuple[int, int]] = []

    def page(self, offset: int) -> int:
        return max((m for m in self.marks if m[0] <= offset), default=self.marks[0])[1]

    def emit(self, size: int) -> Iterator[tuple]:
        text = self.buf[:size].strip(WHITESPACE)
        if text:  # short documents and short tails are passages too
            yield (self.file, self.n, self.page(self.at), self.page(max(self.at, self.at + size - 1)), text,
                   self.at, self.at + size)
            self.n += 1

    def add(self, page: int, text: str) -> Iterator[tuple]:
        self.marks.append((self.end, page))
        text += PAGE_GAP
        self.end += len(text)
        # Long pages enter in pieces, so that trimming the buffer never copies a whole file.
        for lo in range(0, len(text), _BLOCK):
            self.buf += text[lo: lo + _BLOCK]
            while len(self.buf) > TARGET:
                half = TARGET // 2
                spot = max(self.buf.rfind(mark, half, TARGET) for mark in (PAGE_GAP, ". "))
                size = spot + 1 if spot > 0 else TARGET
                yield from self.emit(size)
                self.buf = self.buf[size - OVERLAP:]
                self.at += size - OVERLAP
                keep = max((i for i, m in enumerate(self.marks) if m[0] <= self.at), default=0)
                del self.marks[:keep]

    def finish(self) -> Iterator[tuple]:
        if self.buf:
            yield from self.emit(len(self.buf))


_STREAM_SCHEMA = pa.schema([
    ("file", pa.string()), ("n", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32()),
    ("text", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()),
])


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, f.type) for col, f in zip(zip(*rows), _STREAM_SCHEMA)], schema=_STREAM_SCHEMA
    )


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page rows in (file, page) order; a file may span batches."""
    window: Window | None = None
    for batch in batches:
        rows: list[tuple] = []
        for file, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if window is None or window.file != file:
                if window is not None:
                    rows.extend(window.finish())
                window = Window(file)
            rows.extend(window.add(page, text))
        if rows:
            yield _pack(rows)
    if window is not None:
        rows = list(window.finish())
        if rows:
            yield _pack(rows)


# ---------------------------------------------------------------- one file, many tasks
#
# Where a passage begins depends on the one before it: next(i) = cut(i) - OVERLAP. But next(i) needs only the text from i
# to i + TARGET, and it lies 1,001 to 2,400 characters on. So a segment of the file can tell, for each of the 2,400 places
# at which the chain may enter it, where the chain leaves it and how many passages it emits on the way. Chains that meet
# stay together. These maps are composed along the file, first inside groups of segments, then over groups.

SEGMENT = 1 << 20           # characters; a multiple of _BLOCK
_STEP = TARGET // 2 + 1 - OVERLAP  # the shortest step
_ENTRIES = TARGET - OVERLAP  # places at which a chain may enter a segment
_ENDED = -1                 # the chain ended before
_GROUP = 512                # segments whose maps are composed in one task


class _Segment:
    """Next starts in ``text``, which holds a segment from file offset ``at`` on and TARGET more characters, or the rest."""

    def __init__(self, text: str, at: int, total: int, width: int = SEGMENT):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        line, dot, blank = code == 10, code == 46, code == 32
        marks = np.flatnonzero((line[:-1] & line[1:]) | (dot[:-1] & blank[1:]))
        self.text, self.at, self.width = text, at, min(width, total - at)
        start = np.arange(self.width)
        place = np.searchsorted(marks, start + TARGET - len(PAGE_GAP), "right") - 1
        mark = marks[np.maximum(place, 0)] if len(marks) else np.full(self.width, -1)
        self.cut = np.where((place >= 0) & (mark >= start + TARGET // 2), mark + 1, start + TARGET)
        self.last = total - at - start <= TARGET
        self.cut[self.last] = total - at
        # a passage is emitted if anything but white space is in it
        solid = np.concatenate([[0], np.cumsum(~np.isin(code, _SPACE_CODES))])
        self.emits = solid[self.cut] > solid[start]

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """Per entry: where the chain enters the next segment, and how many passages it emits in this one."""
        exit_, count = np.full(self.width, _ENDED), self.emits.astype(np.int64)
        following = self.cut - OVERLAP
        # a step is longer than _STEP - 1, so that many places at a time need only places already settled
        for high in range(self.width, 0, -_STEP):
            low = max(0, high - _STEP)
            own = np.arange(low, high)[~self.last[low:high]]
            inside = own[following[own] < self.width]
            outside = own[following[own] >= self.width]
            exit_[outside] = following[outside] - self.width
            exit_[inside] = exit_[following[inside]]
            count[inside] += count[following[inside]]
        ends, counts = np.full(_ENTRIES, _ENDED), np.zeros(_ENTRIES, np.int64)
        n = min(_ENTRIES, self.width)
        ends[:n], counts[:n] = exit_[:n], count[:n]
        if n < _ENTRIES:  # a chain that steps over this last, short segment ended before it
            counts[n:] = 0
        return ends, counts

    def passages(self, entry: int, n: int) -> Iterator[tuple[int, int, int, str]]:
        """(n, first, last offset in the file, text) of the passages that begin here."""
        i = entry
        while 0 <= i < self.width:
            j = int(self.cut[i])
            if self.emits[i]:
                yield n, self.at + i, self.at + j, self.text[i:j].strip(WHITESPACE)
                n += 1
            if self.last[i]:
                break
            i = j - OVERLAP


def _then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map of two stretches of a file, one after the other."""
    goes_on = first[0] >= 0
    at = np.maximum(first[0], 0)
    return np.where(goes_on, second[0][at], _ENDED), first[1] + np.where(goes_on, second[1][at], 0)


def _maps(table: pa.Table, order: str) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = sorted(table.select([order, "ends", "counts"]).to_pylist(), key=lambda r: r[order])
    return [(np.frombuffer(r["ends"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows]


def _pieces(width: int):
    """Page rows (file, page, at, total, text) → pieces of at most _BLOCK characters, cut at multiples of it. What lies within
    TARGET characters after the start of a segment is also given to the segment before."""
    schema = pa.schema([("file", pa.string()), ("segment", pa.int64()), ("at", pa.int64()), ("page", pa.int32()), ("total", pa.int64()), ("text", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for file, page, at, total, text in zip(*(c.to_pylist() for c in batch.columns)):
                text, lo = text + PAGE_GAP, 0
                while lo < len(text):
                    hi = min(len(text), lo + _BLOCK - (at + lo) % _BLOCK)
                    segment, inside = divmod(at + lo, width)
                    for to in (segment, segment - 1) if segment and inside < TARGET else (segment,):
                        rows.append((file, to, at + lo, page, total, text[lo:hi]))
                    held, lo = held + hi - lo, hi
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def cut_in_parallel(pages: DataFrame, width: int = SEGMENT) -> DataFrame:
    """pages(file, page, text) → file, n and passage columns, as the stream over one file gives them; a file is cut by as many
    tasks as it has segments of ``width`` characters, a multiple of ``_BLOCK``. Pages of a file have distinct numbers."""
    tidy = materialize(tidy_pages(pages).select("file", F.col("page").cast("int").alias("page"), "text"), "tidy-pages")
    sizes = tidy.select("file", "page", (F.length("text") + len(PAGE_GAP)).cast("bigint").alias("size"))
    totals = sizes.groupBy("file").agg(F.sum("size").alias("total"))
    starts = running_sum_before(sizes, ["file"], "page", F.col("size"), "at").select("file", "page", F.col("at").cast("bigint").alias("at"))
    placed = tidy.join(starts, ["file", "page"]).join(totals, "file").select("file", "page", "at", "total", "text")
    pieces = placed.mapInArrow(_pieces(width), "file string, segment bigint, at bigint, page int, total bigint, text string")
    whole = pieces.groupBy("file", "segment", "total").agg(F.sort_array(F.collect_list(F.struct("at", "page", "text"))).alias("p"))
    segments = materialize(whole.select(
        "file", "segment", "total", F.array_join("p.text", "").alias("text"), F.col("p.at").alias("starts"), F.col("p.page").alias("pages")), "segments")

    def read(row: dict) -> _Segment:
        return _Segment(row["text"], row["segment"] * width, row["total"], width)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, counts = read(row).exits()
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "segment": row["segment"], "part": row["segment"] // _GROUP,
                                                   "ends": ends.astype(np.int64).tobytes(), "counts": counts.tobytes()}])

    def compose(table: pa.Table) -> pa.Table:
        found = None
        for own in _maps(table, "segment"):
            found = own if found is None else _then(found, own)
        return pa.table({"file": table["file"][:1], "part": table["part"][:1], "ends": [found[0].tobytes()], "counts": [found[1].tobytes()]})

    def walk(order: str, entry: int, n: int, table: pa.Table) -> pa.Table:
        numbers, entries, firsts = sorted(table[order].to_pylist()), [], []
        for ends, counts in _maps(table, order):
            entries.append(entry)
            firsts.append(n)
            if entry >= 0:
                entry, n = int(ends[entry]), n + int(counts[entry])
        return pa.table({"file": [table["file"][0].as_py()] * len(numbers), order: numbers, "entry": entries, "first": firsts})

    maps = materialize(segments.select("file", "segment", "total", "text").mapInArrow(
        settle, "file string, segment bigint, part bigint, ends binary, counts binary"), "segment-maps")
    parts = maps.groupBy("file", "part").applyInArrow(compose, "file string, part bigint, ends binary, counts binary")
    entered = parts.groupBy("file").applyInArrow(lambda t: walk("part", 0, 0, t), "file string, part bigint, entry bigint, first bigint").select(
        F.col("file").alias("_file"), F.col("part").alias("_part"), "entry", "first")
    inside = maps.groupBy("file", "part").cogroup(entered.groupBy("_file", "_part")).applyInArrow(
        lambda left, right: walk("segment", right["entry"][0].as_py(), right["first"][0].as_py(), left), "file string, segment bigint, entry bigint, first bigint")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, numbers = np.array(row["starts"]), row["pages"]
                page = lambda at: numbers[int(np.searchsorted(starts, at, "right")) - 1]  # noqa: B023, E731
                rows = [(row["file"], n, page(i), page(max(i, j - 1)), text, i, j) for n, i, j, text in read(row).passages(row["entry"], row["first"])]
                if rows:
                    yield _pack(rows)

    # written, so that its size is known: texts stay where they are while the entries are few enough to be sent
    entries = materialize(inside.filter(F.col("entry") >= 0), "segment-entries")
    ready = segments.join(entries, ["file", "segment"])
    return ready.mapInArrow(emit, f"file string, n int, {_CHUNK_FIELDS}")


def tidy_line(text: str | None) -> str:
    """A page as ``tidy_pages`` leaves it."""
    return _BLANKS.sub(" ", text or "").strip(WHITESPACE)


def document_chunks(file: str, text: str | None) -> Iterator[tuple]:
    """Passages of one text whose lines are pages."""
    window = Window(file)
    for number, line in enumerate((text or "").split("\n"), 1):
        line = tidy_line(line)
        if line:
            yield from window.add(number, line)
    yield from window.finish()


def _document_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents, cut one after the other."""
    for batch in batches:
        rows: list[tuple] = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.extend(document_chunks(file, text))
        if rows:
            yield _pack(rows)


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Earlier corpora win: rows of a file come only from the first corpus that has the file.

    Each corpus is reduced by an anti-join against the distinct file names before it, never by a global sort.
    """
    result, seen = None, None
    for corpus in corpora:
        part = corpus if seen is None else corpus.join(seen, "file", "left_anti")
        names = corpus.select("file").distinct()
        result = part if result is None else result.unionByName(part)
        seen = names if seen is None else seen.unionByName(names).distinct()
    return result


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in the given order.

    ``min_by`` over the order keeps one candidate per key on the map side, so a key that holds a third of all
    rows shuffles one row per task.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = rows.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)]))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), "_o").alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """Documents, passages, and figure passages of an index."""
    return chunks.agg(
        F.countDistinct("file").alias("docs"), F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("id").startswith("fig:")).alias("figures"),
    )


def scan_totals(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a figure scan saw: its documents, pages, and figure candidates. One number each, so the rows of both are joined."""
    seen = pages.agg(F.countDistinct("file").alias("scanned_docs"), F.count(F.lit(1)).alias("scanned_pages"))
    return seen.join(candidates.agg(F.count(F.lit(1)).alias("candidates")))


def page_at_offset(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(file, at) → page whose text covers the character: the last page start at or before it.

    Page starts and questions are merged in offset order per file, so cost is linear in both.
    """
    size = F.length("text") + len(PAGE_GAP)
    numbered = tidy_pages(pages).select("file", F.col("page").cast("int").alias("page"), size.alias("size"))
    starts = running_sum_before(numbered, ["file"], "page", F.col("size"), "at").select(
        "file", F.col("at").cast("bigint").alias("at"), "page", F.lit(0).alias("kind"))
    asked = offsets.select("file", F.col("at").cast("bigint").alias("at"), F.lit(None).cast("int").alias("page"),
                           F.lit(1).alias("kind"))
    found = last_known(starts.unionByName(asked), ["file"], ["at", "kind"], F.col("page"), "found", width=_BLOCK * 64)
    return found.filter(F.col("kind") == 1).select("file", "at", F.col("found").alias("page"))
