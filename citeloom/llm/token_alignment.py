"""Alignment of two tokenizers' tokens over byte offsets, with corpus-wide counts of linked token pairs."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import in_pieces, materialize, text_of
from citeloom.llm.packing import byte_alphabet
from citeloom.session import LARGE_ROWS

BLOCK_BYTES = 8 << 20
UNITS_AT_ONCE = 4096  # an encoding of the library takes about a thousand bytes

#: A unit starts at a blank or line feed after a character that is no white space. Tokens of neither vocabulary cross
#: such a place, so units are encoded by themselves. Other white space stays inside its unit.
UNIT = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
MARK = "▁"  # fixed value: how pieces show a space


class Vocabularies:
    """Both tokenizers, the bytes of each of their ids, and the identity map from A ids to B ids of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        added = self.a.get_added_tokens_decoder()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = b"" if i in added else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)) for i in range(len(pieces))]
        self.bytes_b = [p.replace(MARK, " ").encode() if ok else bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b""
                        for i, (p, ok) in enumerate(zip(pieces, plain))]
        self.length_a = np.array([len(x) for x in self.bytes_a], "int64")
        self.length_b = np.array([len(x) for x in self.bytes_b], "int64")
        # whole pieces come after byte pieces, so that they win where both have the same bytes
        same = {x: i for _, i, x in sorted((ok, i, x) for i, (ok, x) in enumerate(zip(plain, self.bytes_b))) if x}
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.bytes_a], "int64")
        self.space = self.b.piece_to_id(MARK)
        # what the cutting into units rests on; a vocabulary without it is encoded text by text
        crossing = re.compile(f"[^{MARK}]{MARK}|\n")
        layout = self.a.pre_tokenizer is not None and self.a.normalizer is None and "ByteLevel" in str(self.a.pre_tokenizer)
        self.by_units = layout and not any(ok and crossing.search(p) for p, ok in zip(pieces, plain))

    def units(self, text: str) -> list[str]:
        return UNIT.findall(text) if self.by_units else [text]

    def ids_a(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch(units, add_special_tokens=False)]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """B adds a space in front, so a unit's own space is left out; before a line feed the added space is a token
        of its own, which is dropped."""
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [([self.space] if u == " " else ids) if u[0] == " " else ids[1:] for u, ids in zip(units, out)]


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """The worker's tokenizers, loaded once per process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Vocabularies(path_a, path_b)
    return _LOADED[path_a, path_b]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` of them) for all i, one after another."""
    start = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(start - first, count)


class Aligned:
    """Tokens, groups and links of distinct units, worked out ``UNITS_AT_ONCE`` at a time.

    ``shape`` has a row per unit: A tokens, B tokens, groups, links. One-to-one groups of equal bytes are named by their A
    id (``same``), links of all other groups by a packed pair (``pairs``); both lists are in order of their units, and
    ``same_at`` and ``pairs_at`` tell where each unit's stretch begins. ``broken`` units are not given back by their tokens.
    """

    def __init__(self, tools: Vocabularies, units: list[str]):
        parts = [self._some(tools, units[at:at + UNITS_AT_ONCE]) for at in range(0, len(units), UNITS_AT_ONCE)]
        self.broken, self.shape, self.same, same_n, self.pairs, pairs_n = (np.concatenate(c) for c in zip(*(p[:-1] for p in parts)))
        self.same_at, self.pairs_at = (np.concatenate([[0], np.cumsum(n)]) for n in (same_n, pairs_n))
        self.texts = list(chain.from_iterable(p[-1] for p in parts))

    def _some(self, tools: Vocabularies, units: list[str]) -> tuple:
        ids_a, ids_b = tools.ids_a(units), tools.ids_b(units)
        bytes_a, bytes_b = tools.bytes_a, tools.bytes_b
        broken = np.zeros(len(units), bool)
        for i, unit in enumerate(units):
            raw = unit.encode()
            if b"".join([bytes_a[x] for x in ids_a[i]]) != raw or b"".join([bytes_b[x] for x in ids_b[i]]) != raw:
                broken[i], ids_a[i], ids_b[i] = True, [], []
        n_a, n_b = (np.fromiter(map(len, x), "int64", len(units)) for x in (ids_a, ids_b))
        a = np.fromiter(chain.from_iterable(ids_a), "int64", int(n_a.sum()))
        b = np.fromiter(chain.from_iterable(ids_b), "int64", int(n_b.sum()))
        # units lie end to end on one axis of bytes
        end_a, end_b = np.cumsum(tools.length_a[a]), np.cumsum(tools.length_b[b])
        start_a, start_b = end_a - tools.length_a[a], end_b - tools.length_b[b]
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        unit_of = np.repeat(np.arange(len(units)), n_a)[first_a]
        single = (in_a == 1) & (in_b == 1)
        single[single] = tools.identity[a[first_a[single]]] == b[first_b[single]]
        odd = ~single[group_a]
        low, high = np.searchsorted(end_b, start_a[odd], "right"), np.searchsorted(start_b, end_a[odd], "left")
        pairs = np.repeat(a[odd], high - low) << 32 | b[_ranges(low, high - low)]
        same_n = np.bincount(unit_of[single], minlength=len(units))
        pairs_n = np.bincount(np.repeat(unit_of[group_a[odd]], high - low), minlength=len(units))
        shape = np.stack([n_a, n_b, np.bincount(unit_of, minlength=len(units)), same_n + pairs_n], axis=1)
        return broken, shape, a[first_a[single]], same_n, pairs, pairs_n, self._texts(ids_a, ids_b, unit_of, in_a, in_b)

    @staticmethod
    def _texts(ids_a, ids_b, unit_of, in_a, in_b) -> list[str]:
        """Groups of each unit as ``a1,a2|b1;a3|b2,b3``."""
        out, group, cuts = [], 0, list(zip(unit_of.tolist(), in_a.tolist(), in_b.tolist()))
        for unit, (left, right) in enumerate(zip(ids_a, ids_b)):
            parts, i, j = [], 0, 0
            while group < len(cuts) and cuts[group][0] == unit:
                _, m, n = cuts[group]
                parts.append(f"{left[i]}|{right[j]}" if m == n == 1 else
                             ",".join(map(str, left[i:i + m])) + "|" + ",".join(map(str, right[j:j + n])))
                i, j, group = i + m, j + n, group + 1
            out.append(";".join(parts))
        return out


class _Numbered(dict):
    """Numbers keys in the order of their first appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


_BLOBS = ("doc_at", "unit", "times", "same", "same_at", "pair_at", "pair_no")
BLOCK_SCHEMA = ("block bigint, doc_id array<bigint>, shape binary, digest array<string>, "
                + ", ".join(f"{b} binary" for b in _BLOBS) + ", pair array<bigint>, n array<bigint>, vector array<bigint>")
SCHEMA = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _block(tools: Vocabularies, number: int, ids: list, texts: list[str], vector: np.ndarray) -> list:
    """One row of ``BLOCK_SCHEMA``; one-to-one groups are added to ``vector``."""
    seen, codes = _Numbered(), []
    for text in texts:
        # a mark in a text would be read as a space; such a text has no tokens
        codes.append(np.fromiter(map(seen.__getitem__, tools.units(" " + text)) if text and MARK not in text else [], "int32"))
    known = Aligned(tools, list(seen)) if seen else None
    digests, kept = [], []
    for own in codes:
        if known is None or not len(own) or known.broken[own].any():
            digests.append("")
            kept.append(own[:0])
        else:
            digests.append(hashlib.sha256(";".join([known.texts[c] for c in own.tolist()]).encode()).hexdigest())
            kept.append(own)
    # document by document: sorting all their units at once takes 80 MB
    own = [np.unique(k, return_counts=True) for k in kept]
    unit, times = (np.concatenate([np.zeros(0, "int64"), *c]).astype("int64") for c in zip(*own)) if own else (np.zeros(0, "int64"),) * 2
    doc_at = np.concatenate([[0], np.cumsum([len(u) for u, _ in own], dtype="int64")])
    del codes, kept, own
    shape = np.zeros((len(texts), 4), "int64")
    blobs = dict.fromkeys(_BLOBS, b"")
    pair, n = np.zeros(0, "int64"), np.zeros(0, "int64")
    if known is not None:
        for c in range(4):
            shape[:, c] = _stretch_sums(known.shape[unit, c] * times, doc_at)
        uses = np.bincount(unit, weights=times, minlength=len(seen)).astype("int64")
        np.add.at(vector, known.same, np.repeat(uses, np.diff(known.same_at)))
        pair, number_of = np.unique(known.pairs, return_inverse=True)
        n = np.bincount(number_of, weights=np.repeat(uses, np.diff(known.pairs_at)), minlength=len(pair)).astype("int64")
        found = {"doc_at": doc_at, "unit": unit, "times": times, "same": known.same, "same_at": known.same_at,
                 "pair_at": known.pairs_at, "pair_no": number_of}
        blobs = {k: v.astype("<u4").tobytes() for k, v in found.items()}
    return [number, ids, shape.astype("<i8").tobytes(), digests, *(blobs[b] for b in _BLOBS), pair, n, np.zeros(0, "int64")]


def _stretch_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact sums of the stretches between the offsets ``at``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _give_back() -> None:
    """Freed memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def alignment_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents with their units, the units' links, and the block's count of every irregular pair.

    A block ends when its texts hold ``block_bytes``; one longer text is a block of its own. Counts of one-to-one groups
    are kept in a vector as long as A's vocabulary, which a task's last block, one without documents, carries. Blocks leave one
    by one, and what their making took is given back to the system, so a worker holds one block however many it makes.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("shape", pa.binary()), ("digest", pa.list_(pa.string())),
                        *((b, pa.binary()) for b in _BLOBS), *((c, pa.list_(pa.int64())) for c in ("pair", "n", "vector"))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = vocabularies(path_a, path_b)
        vector = np.zeros(len(tools.bytes_a), "int64")
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def row(values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in in_pieces(batches, 4 << 20):
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            held += batch.nbytes
            if held >= block_bytes:
                made = row(_block(tools, number, ids, texts, vector))
                ids, texts, held, number = [], [], 0, number + 1
                yield made
                del made
                _give_back()
        if ids:
            yield row(_block(tools, number, ids, texts, vector))
            number += 1
        if vector.any():
            yield row([*_block(tools, number, [], [], vector)[:-1], vector])
        _give_back()

    return source.mapInArrow(align, BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pair, a, b, n, same`` of every linked pair in the corpus; ``same`` tells pairs that also occur one to one."""
    tools = vocabularies(path_a, path_b)
    spark = blocks.sparkSession
    # one row per A id: bounded by the vocabulary
    identity = F.broadcast(spark.createDataFrame([(i, b) for i, b in enumerate(tools.identity.tolist()) if b >= 0], "a bigint, b bigint"))
    vector = blocks.select(F.posexplode("vector").alias("a", "n")).filter(F.col("n") > 0).groupBy("a").agg(F.sum("n").alias("n"))
    whole = vector.withColumn("a", F.col("a").cast("bigint")).join(identity, "a").select(
        (F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), "n", F.lit(True).alias("same"))
    other = blocks.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).select("p.pair", "p.n", F.lit(False).alias("same"))
    every = whole.unionByName(other).groupBy("pair").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
    return every.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "same")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document, how tokens of A over space+text and of B over text overlap: columns of ``SCHEMA``.

    A one-to-one group whose B id is the identity map's entry for its A id takes the fast path: its count lies in a vector
    as long as the vocabulary, which is summed and looked up without a join. Only pairs of the other groups are shuffled,
    summed per block before. Documents never travel: a block's distinct units, with the pairs of each, are written once
    and meet the corpus counts of the block's pairs.

    ``n_links`` are token pairs whose bytes overlap, ``count_sum`` adds the corpus-wide count of each link's pair,
    ``n_best`` are links whose count is the highest of their B id, ties included.

    Nulls: a null id is kept; null and empty texts, and texts that the tokens do not give back (those that hold U+2581),
    have no tokens: zeros and an empty digest. Repeated rows are separate documents and all are counted. A text of any
    length is read whole. An empty table gives an empty result. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    blocks = materialize(alignment_blocks(docs, path_a, path_b, id_col, text_col, block_bytes), "align-blocks", **LARGE_ROWS)
    counts = materialize(pair_counts(blocks, path_a, path_b), "align-pairs")
    # both are bounded by a vocabulary: one row per B id, one per A id
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("best")))
    judged = counts.join(best, "b").select("pair", "a", "n", (F.col("n") == F.col("best")).alias("is_best"), "same")
    size = len(vocabularies(path_a, path_b).bytes_a)
    table = np.zeros((2, size), "int64")
    for r in judged.filter("same").select("a", "n", "is_best").collect():
        table[:, r["a"]] = r["n"], r["is_best"]
    whole = spark.sparkContext.broadcast(table)
    wanted = blocks.select(F.col("block").alias("asked"), F.posexplode("pair").alias("no", "pair"))
    known = wanted.join(judged.select("pair", "n", "is_best"), "pair").select("asked", "no", "n", "is_best")
    names = SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["no"].to_numpy())
        counted = [right["n"].to_numpy()[order], right["is_best"].to_numpy().astype("int64")[order]]
        parts = []
        for row in left.to_pylist():
            at = {b: np.frombuffer(row[b], "<u4").astype("int64") for b in _BLOBS}
            shape = np.frombuffer(row["shape"], "<i8").reshape(-1, 4)
            sums = []
            for odd, even in zip(counted, whole.value):
                if len(at["unit"]):
                    per_unit = _stretch_sums(even[at["same"]], at["same_at"]) + _stretch_sums(odd[at["pair_no"]], at["pair_at"])
                    sums.append(_stretch_sums(per_unit[at["unit"]] * at["times"], at["doc_at"]))
                else:
                    sums.append(np.zeros(len(shape), "int64"))
            parts.append(pa.table([pa.array(row["doc_id"], pa.int64()), *(pa.array(shape[:, c]) for c in range(4)), pa.array(sums[1]),
                                   pa.array(sums[0]), pa.array(row["digest"], pa.string())], names=names))
        return pa.concat_tables(parts)

    rows = blocks.drop("pair", "n", "vector")
    return rows.groupBy("block").cogroup(known.groupBy("asked")).applyInArrow(answer, SCHEMA)
