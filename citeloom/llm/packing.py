"""Packing token sequences by first-fit decreasing with a tournament tree of bin capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import in_pieces, materialize, text_of, unpack_u32

CAPACITY = 1024
GROUP_PIECES = 8192
END_ID = 0

# Fixed value: how the byte-level vocabulary splits text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which the two libraries' regular-expression engines are known to agree.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*").fullmatch
LONG_RUN = re.compile(r"[^ \n]{2000}").search


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """Ids of a text as the tokenizer file's own library gives them.

    Ordinary texts go through the faster of the two libraries, with merge ranks read from the same file; a text with
    an added token, an unusual character or a very long unbroken run goes through the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items()
                 if i not in added}
        self.fast = tiktoken.Encoding("bytes", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if PLAIN(text) and not LONG_RUN(text) and not any(s in text for s in self.special):
            ids = self.fast(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4")


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """The worker's encoder for a tokenizer file; loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


class Bins:
    """Open bins under a tournament tree: each inner node holds the larger capacity of its two children."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.used = capacity, 0
        self.width = 1 << max(0, (most - 1).bit_length())
        self.tree = [0] * (2 * self.width)

    def _set(self, bin_: int, room: int) -> None:
        tree, node = self.tree, bin_ + self.width
        tree[node] = room
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1

    def place(self, length: int) -> tuple[int, int]:
        """First bin with room for ``length``, opening one if none has; (bin, offset inside it)."""
        tree = self.tree
        if tree[1] < length:
            bin_, room = self.used, self.capacity
            self.used += 1
        else:
            node = 1
            while node < self.width:
                node *= 2
                if tree[node] < length:
                    node += 1
            bin_, room = node - self.width, tree[node]
        self._set(bin_, room - length)
        return bin_, self.capacity - room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties keep their order."""
    bins = Bins(capacity, len(lengths))
    where, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    for i in np.argsort(-lengths, kind="stable").tolist():
        where[i], offset[i] = bins.place(int(lengths[i]))
    return where, offset


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids followed by the end id, cut into pieces of ``capacity`` and a rest.

    A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, _row`` and the piece's ids (``_ids``, little-endian
    unsigned 32-bit). ``_row`` numbers documents by task and position.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _row bigint, _ids binary"
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    width = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 33
        end = END_ID.to_bytes(4, "little")
        for batch in in_pieces(batches, 8 << 20):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = tool.encode(text).tobytes() + end
                total = len(data) // 4
                for at in range(0, len(data), width):
                    piece = data[at:at + width]
                    for column, value in zip(out, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), total, row, piece)):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row", "_ids"])

    return source.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 9) -> DataFrame:
    """Give every piece a place: ``pieces`` plus ``sequence_id, offset``.

    Documents are dealt to random groups by a hash of their row number, about ``group_pieces`` pieces each, and a group
    is packed by itself, so a group's task is small however large the corpus or a source is. A piece keeps its columns;
    ``_ids`` should be dropped before, as only lengths decide. Sequence ids hold the group in their upper bits.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_row", F.floor(F.col("start") / (capacity * 64))), F.lit(groups)))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    names = pieces.columns

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_row", "start"], kind="stable")
        where, offset = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group[names].assign(sequence_id=(int(key[0]) << 24) + where, offset=offset)

    return dealt.groupBy("_group").applyInPandas(fit, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document lies:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; no piece is longer than ``capacity``.

    Texts are read once, to make pieces; only their lengths, checksums and row numbers are written and shuffled. The ids
    themselves come again from ``token_pieces`` when ``fill_sequences`` writes sequences.

    Nulls: a null text is empty and gives one piece, the end id alone; a null id is kept. Repeated rows are separate
    documents. A text of any length is cut into as many pieces as it needs; they may lie in different groups. An empty
    table gives an empty result. Columns other than the two named are not read.
    """
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, capacity).drop("_ids"), "pack-pieces")
    return pack(pieces, capacity).drop("_row")


def fill_sequences(packed: DataFrame, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` with ids as an array of at most ``capacity``, unpadded.

    ``packed`` comes from ``pack`` with its ``_row`` and ``pieces`` from the same ``token_pieces`` table.
    """
    spots = packed.select("_row", "start", "sequence_id", "offset")
    rows = pieces.select("_row", "start", "_ids").join(spots, ["_row", "start"])

    def join_up(key, group: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(group.sort_values("offset")["_ids"])
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [list(unpack_u32(data))]})

    return rows.groupBy("sequence_id").applyInPandas(join_up, "sequence_id bigint, ids array<bigint>")
