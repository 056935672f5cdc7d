"""Exact Jaccard join of word n-gram sets, by token-combination prefixes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import TextCache, in_pieces, materialize, text_of, wrapped
from citeloom.llm.components import connected
from citeloom.session import small_side

SHINGLE_WORDS = 4
PERCENT = 85
SKETCH_BITS = 18       # buckets of the frequency sketch: its size is fixed, whatever the corpus
MERGE_TASKS = 8
TOKENS_PER_GROUP = 4   # frequent tokens of a document that one combination group should hold
HOT_ROWS = 100_000     # documents that share a signature before its rows are dealt to several tasks
BLOCK = 2048           # documents of a signature that are compared in one task
PARITY_BITS = 1024     # of the smallest parity bitmap; a larger set has a bit per token, at least
PARTNERS = 256         # of one set that are verified in one task
SMALL_ROWS = 1_000_000 # rows of (id, key) up to which a side is broadcast: at most some 50 MB; longer ones are shuffled

_MIX = [np.uint64(xxhash.xxh64_intdigest(bytes([i])) | 1) for i in range(16)]
_FINAL = np.uint64(xxhash.xxh64_intdigest(b"final") | 1)


def least_overlap(total: int, percent: int) -> int:
    """Smallest overlap at which two sets whose sizes add up to ``total`` link."""
    return -(-percent * total // (100 + percent))


def allowed_missing(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` may be absent from a set that it links with."""
    return n - -(-percent * n // 100)


class Shingler:
    """Sets of hashed word n-grams; a word's hash is kept in a bounded cache."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.hashes = TextCache(xxhash.xxh64_intdigest, 12 << 20)

    def tokens(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes. ASCII letters are lowered, white space is ASCII white space."""
        parts = text.encode("utf-8").lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, parts), dtype=np.uint64, count=len(parts))
        k = min(self.words, len(h))
        if not k:
            return h
        out = h[:len(h) - k + 1] * _MIX[0]
        for i in range(1, k):
            out = out + h[i:len(h) - k + 1 + i] * _MIX[i]
        out ^= out >> np.uint64(32)
        out *= _FINAL
        out ^= out >> np.uint64(29)
        return np.unique(out)


def set_key(tokens: np.ndarray, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(tokens.tobytes(), seed)
    return value - (1 << 64) if value >> 63 else value


_SHINGLERS: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    if words not in _SHINGLERS:
        _SHINGLERS[words] = Shingler(words)
    return _SHINGLERS[words]


def describe(docs: DataFrame, id_col: str, text_col: str, words: int, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, text_key, key, check, n_shingles, bits, sketch``: a row per document, and per task one with a sketch alone.

    ``key`` stands for the set (null for an empty one), ``check`` is a second hash of it, ``bits`` its parity bitmap. The sketch counts, per bucket
    of token hashes, the sets that a task saw for the first time.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    mask = np.uint64((1 << sketch_bits) - 1)
    names = ["doc_id", "text_key", "key", "check", "n_shingles", "bits", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = shingler(words), set()
        counts = np.zeros(1 << sketch_bits, dtype=np.uint64)
        for batch in in_pieces(batches, 2 << 20):
            keys, checks, sizes, bits, fresh = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = tool.tokens(text)
                key = set_key(tokens) if len(tokens) else None
                keys.append(key)
                checks.append(set_key(tokens, 1) if len(tokens) else None)
                sizes.append(len(tokens))
                bits.append(parity(tokens) if len(tokens) else None)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    fresh.append(tokens)
            if fresh:
                counts += np.bincount((np.concatenate(fresh) & mask).astype(np.int64), minlength=len(counts)).astype(np.uint64)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (keys, checks, sizes)),
                                              pa.array(bits, pa.binary()), pa.nulls(len(keys), pa.binary())], names=names)
        if counts.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.nulls(1, pa.binary()), pa.array([pa.compress(counts.tobytes(), "zstd", asbytes=True)], pa.binary())], names=names)

    return source.mapInArrow(run, "doc_id bigint, text_key bigint, key bigint, check bigint, n_shingles bigint, bits binary, sketch binary")


def _unpacked(data: bytes, sketch_bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 << sketch_bits, codec="zstd", asbytes=True), dtype=np.uint64)


def frequencies(sketches: DataFrame, sketch_bits: int = SKETCH_BITS) -> np.ndarray:
    """The sketches of all tasks added up. ``MERGE_TASKS`` tasks add them first; the driver gets that many arrays of
    fixed size, and the sum is what tasks are sent: 2 ** ``sketch_bits`` numbers however large the corpus."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << sketch_bits, dtype=np.uint64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += _unpacked(data, sketch_bits)
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(counts.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["sketch"])

    total = np.zeros(1 << sketch_bits, dtype=np.uint64)
    for row in sketches.select("sketch").repartition(MERGE_TASKS).mapInArrow(add, "sketch binary").collect():
        total += _unpacked(bytes(row[0]), sketch_bits)
    return total


class Signer:
    """Signatures of sets, such that linked sets share at least one.

    Tokens stand in one global order, rare ones first by the sketch. Tokens of class 1 are rare and are signatures by
    themselves; tokens of class c are frequent and only combinations of c of them, out of the same hash group, are
    signatures. The prefix of a set is extended until, whatever ``allowed_missing`` tokens are struck out, some group
    keeps as many tokens as its class asks for: a group of m tokens of class c stands m - c + 1 strikes. Of two linked
    sets, all common tokens of the prefix that ends first are in the other prefix too, so they share a signature.
    The number of hash groups depends on the size of the set; a set signs for its own size and for the smallest size
    that it may link with, so two linked sets always have a number in common.
    """

    def __init__(self, counts: np.ndarray, percent: int = PERCENT, hot_rows: int = HOT_ROWS):
        self.percent, self.hot_rows = percent, hot_rows
        used = counts[counts > 0]
        self.mean = float(used.mean()) if len(used) else 0.0
        spread = np.sqrt(self.mean)
        self.classes = (1 + (counts > self.mean + 6 * spread + 8).astype(np.uint8) + (counts > self.mean + 60 * spread + 512)).astype(np.uint8)
        self.order = np.minimum(65_535, np.round(np.log2(1.0 + counts) * 1024)).astype(np.uint16)
        self.excess = np.maximum(0.0, counts - self.mean).astype(np.float32)
        self.single = (counts == 1)
        self.mask = np.uint64(len(counts) - 1)

    def groups(self, n: int) -> int:
        most = max(1, allowed_missing(n, self.percent) // TOKENS_PER_GROUP)
        return 1 << (most.bit_length() - 1)

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(signatures, over how many tasks each should be dealt, number of rare tokens in the whole set)."""
        n = len(tokens)
        at = (tokens & self.mask).astype(np.int64)
        classes = self.classes[at]
        rare = int((classes == 1).sum())
        if 100 * n < self.percent * (n + 1):  # so small that it links with equal sets only
            return np.empty(0, np.uint64), np.empty(0, np.int64), rare
        order = np.argsort(self.order[at], kind="stable")
        need = allowed_missing(n, self.percent) + 1
        first = order[:need]
        if (classes[first] == 1).all():
            return self._single(tokens, at, first) + (rare,)
        sigs, deals = [], []
        for groups in {self.groups(n), self.groups(-(-self.percent * n // 100))}:
            s, d = self._combined(tokens, at, classes, order, need, groups)
            sigs.append(s)
            deals.append(d)
        found, where = np.unique(np.concatenate(sigs), return_index=True)
        return found, np.concatenate(deals)[where], rare

    def _single(self, tokens, at, chosen):
        chosen = chosen[~self.single[at[chosen]]]  # a token that only this set holds is shared with none
        return tokens[chosen], 1 + (self.excess[at[chosen]] // self.hot_rows).astype(np.int64)

    def _combined(self, tokens, at, classes, order, need, groups):
        held: dict[tuple[int, int], list[int]] = {}
        singles, strength = [], 0
        for i in order.tolist():
            c = int(classes[i])
            if c == 1:
                singles.append(i)
                strength += 1
            else:
                group = held.setdefault((c, int(tokens[i] >> np.uint64(40)) % groups), [])
                group.append(i)
                strength += len(group) >= c
            if strength >= need:
                break
        sigs, deals = self._single(tokens, at, np.array(singles, dtype=np.int64))
        made, rows = [], []
        for (c, _), group in held.items():
            for combo in combinations(group, c):
                data = np.sort(tokens[list(combo)]).tobytes() + groups.to_bytes(4, "little")
                made.append(xxhash.xxh64_intdigest(data))
                rows.append(1 + int(min(self.excess[at[i]] for i in combo) // self.hot_rows))
        if made:
            sigs = np.concatenate([sigs, np.array(made, dtype=np.uint64)])
            deals = np.concatenate([deals, np.array(rows, dtype=np.int64)])
        return sigs, deals


def signatures(docs: DataFrame, text_col: str, words: int, signer: Signer) -> DataFrame:
    """``sig, salt, key, n, rare``: a row per signature of each set that a task sees for the first time."""
    names = ["sig", "salt", "key", "n", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = shingler(words), set()
        for batch in in_pieces(batches, 2 << 20):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for text in batch.column(0).to_pylist():
                tokens = tool.tokens(text)
                key = set_key(tokens) if len(tokens) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                sigs, deals, rare = signer.of(tokens)
                if len(sigs):
                    salt = np.where(deals > 1, key % deals, -1)
                    for part, value in zip(parts, (sigs.view(np.int64), salt, np.full(len(sigs), key), np.full(len(sigs), len(tokens)), np.full(len(sigs), rare))):
                        part.append(value)
            if len(seen) > 1_000_000:
                seen.clear()
            if parts[0]:
                arrays = [np.concatenate(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(arrays, ("int64", "int32", "int64", "int32", "int32"))], names=names)

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "sig bigint, salt int, key bigint, n int, rare int")


def stars(rows: DataFrame) -> DataFrame:
    """``sig, salt, key, n, pivot, pivot_n, several``: every set that shares a signature, with the signature's first set.

    The first is the one with the fewest rare tokens: what copies of a text have in common is frequent, what was changed
    in each is rare, so that is the likely centre of a group. Rows come sorted, so a task keeps two rows in mind, not a
    signature's members. A signature with a single set is left out, unless other tasks hold sets of it (salt 0 or more).
    ``several`` tells whether there may be more than two sets; two are fully compared by their one pair.
    """
    names = ["sig", "salt", "key", "n", "pivot", "pivot_n", "several"]
    kinds = ("int64", "int32", "int64", "int32", "int64", "int32", "bool")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last signature while it has fewer than three sets
        long = None  # (sig, salt, key, pivot, pivot_n) of the last signature once it has three

        def cut(columns: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
            nonlocal held, long
            sig, salt, key, n = columns
            first = np.ones(len(sig), dtype=bool)
            first[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
            before = long
            goes_on = before is not None and len(sig) > 0 and before[0] == sig[0] and before[1] == salt[0]
            twice = np.zeros(len(sig), dtype=bool)
            twice[1:] = ~first[1:] & (key[1:] == key[:-1])
            if goes_on:
                twice[0] = before[2] == key[0]
            last_key = key[-1]
            last_spot = (sig[-1], salt[-1])
            run_of = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            pivot, pivot_n = key[starts], n[starts]
            sizes = np.bincount(run_of, weights=~twice, minlength=len(starts)).astype(np.int64)
            if goes_on:
                pivot[0], pivot_n[0] = before[3], before[4]
                sizes[0] += 3
            open_run = len(starts) - 1
            waits = not last and sizes[open_run] < 3
            long = None if sizes[open_run] < 3 else (*last_spot, last_key, pivot[open_run], pivot_n[open_run])
            held = [c[starts[open_run]:][~twice[starts[open_run]:]] for c in columns] if waits else None
            keep = ~twice & ((sizes[run_of] > 1) | (salt >= 0))
            if waits:
                keep &= run_of != open_run
            several = (sizes[run_of] > 2) | (salt >= 0)
            out = [c[keep] for c in (sig, salt, key, n, pivot[run_of], pivot_n[run_of], several)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(out, kinds)], names=names) if len(out[0]) else None

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("sig", "salt", "key", "n")]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            if len(columns[0]):
                made = cut(columns, False)
                if made:
                    yield made
        if held is not None:
            made = cut(held, True)
            if made:
                yield made

    dealt = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "rare", "key")
    return dealt.mapInArrow(run, "sig bigint, salt int, key bigint, n int, pivot bigint, pivot_n int, several boolean")


def parity(tokens: np.ndarray) -> bytes:
    """Bitmap whose bit i tells whether an odd number of tokens hash to i. Two sets differ in at least as many tokens as
    their bitmaps in bits, so a pair whose bitmaps differ too much is ruled out for certain. Its width is a power of two
    and grows with the set, so that long texts are told apart, too; a wider one is folded onto a narrower."""
    width = max(PARITY_BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one width as rows of ``words`` 64-bit words; parts of a wider bitmap are added modulo two."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1, words), axis=1)


def bits_apart(x: bytes, y: bytes) -> int:
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded([x], words) ^ folded([y], words)).sum())


def most_apart(total, percent: int):
    """In how many tokens two sets that link may differ, if their sizes add up to ``total``."""
    return total - 2 * -(-percent * total // (100 + percent))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that their bitmaps do not rule out, with the bits in which these differ (``apart``)."""
    left, right = (classes.select(F.col("key").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            apart = np.array([bits_apart(x, y) for x, y in zip(*(batch.column(f"bits_{s}").to_pylist() for s in "ab"))], np.int64)
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            fits = pa.array(apart <= most_apart(total, percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(fits) for c in ("a", "b")), pa.array(apart).filter(fits)], names=["a", "b", "apart"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint, apart bigint")


def _sent_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``to, part, centre, key, tokens``: the sets of ``wanted(doc_id, key, uses)``, once for each of its uses."""
    right = small_side(wanted.select(F.col("doc_id").alias("_wanted"), F.col("key").alias("_key"), F.col("uses").alias("_uses")), SMALL_ROWS)
    source = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text")).join(
        right, F.col("_id").eqNullSafe(F.col("_wanted"))).select("_key", "_text", "_uses")
    names = ["to", "part", "centre", "key", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shingler(words)
        for batch in in_pieces(batches, 2 << 20):
            rows, held = [], 0
            for key, text, uses in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tool.tokens(text)
                if not len(tokens) or set_key(tokens) != key:
                    continue
                data = tokens.tobytes()
                for use in uses:
                    rows.append((use["to"], use["part"], use["centre"], key, data))
                    held += len(data)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    return source.mapInArrow(run, "to bigint, part int, centre boolean, key bigint, tokens binary")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, percent: int, partners: int = PARTNERS) -> DataFrame:
    """The pairs ``a, b`` whose sets link, by their exact overlap. Only sets of the pairs are made.

    A pair is compared where the set of its ``b`` is: each set moves once per partner, whole 64-bit hashes and all, in one
    shuffle. Partners of a set beyond ``partners`` are dealt to several parts, each with a copy of that set.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / partners).cast("int").alias("parts"))
    dealt = pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    use = lambda centre: F.struct(F.col("b").alias("to"), "part", F.lit(centre).alias("centre"))
    members = dealt.select(F.col("a").alias("key"), use(False).alias("use"))
    centres = dealt.select("b", "part").distinct().select(F.col("b").alias("key"), use(True).alias("use"))
    uses = members.unionByName(centres).groupBy("key").agg(F.collect_set("use").alias("uses"))
    wanted = materialize(uses.join(classes, "key").select(F.col("least").alias("doc_id"), "key", "uses"), "ngram-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            found = []
            for to, part, is_centre, key, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.uint64)
                if is_centre:
                    at, centre = (to, part), tokens
                elif at == (to, part):
                    both = np.concatenate([centre, tokens])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        found.append((key, to))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    sent = _sent_sets(docs, wanted, id_col, text_col, words).select("to", "part", "centre", "key", "tokens")
    ordered = sent.repartition("to", "part").sortWithinPartitions("to", "part", F.col("centre").desc())
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def across(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of different components that share a signature and are not ruled out by size or bitmap.

    ``rows(sig, low, high, block, key, n, root, bits)`` come dealt in blocks of bounded size: a task sees the members of
    one block, or of two, never a whole frequent signature, and gives only pairs that may link.
    """
    def compare(rows_: list[tuple], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, key, n, root = (np.array(c, np.int64) for c in list(zip(*rows_))[:4])
        bits = [r[4] for r in rows_]
        width = np.array([len(b) // 8 for b in bits])
        for words in np.unique(width).tolist():
            # a set is compared with sets of its own width and with wider ones, which are folded
            left, right = np.flatnonzero(width == words), np.flatnonzero(width >= words)
            narrow = np.zeros((len(rows_), words), np.uint64)
            for other in np.unique(width[right]).tolist():
                own = np.flatnonzero(width == other)
                narrow[own] = folded([bits[i] for i in own.tolist()], words)
            for start in range(0, len(left), 64):
                some = left[start:start + 64]
                total = n[some, None] + n[right]
                fits = (root[some, None] != root[right]) & ((width[right] > words) | (key[some, None] < key[right]))
                fits &= 100 * np.minimum(n[some, None], n[right]) >= percent * np.maximum(n[some, None], n[right])
                if low != high:
                    fits &= block[some, None] != block[right]
                i, j = np.nonzero(fits)
                if len(i):
                    x, y = some[i], right[j]
                    close = np.bitwise_count(narrow[x] ^ narrow[y]).sum(1, dtype=np.int64) <= most_apart(total[i, j], percent)
                    yield np.minimum(key[x], key[y])[close], np.maximum(key[x], key[y])[close]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for a, b in compare(held, at[1], at[2]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for sig, low, high, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (sig, low, high) != at:
                    yield from flush()
                    at, held = (sig, low, high), []
                held.append(tuple(rest))
        yield from flush()

    ordered = rows.select("sig", "low", "high", "block", "key", "n", "root", "bits").repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT,
         hot_rows: int = HOT_ROWS, block: int = BLOCK, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, text_key, n_shingles, key, root, component_id``: the component of every document under all links.

    Two documents link when 100 * overlap >= ``percent`` * union of their sets of ``words``-word shingles. Documents of
    equal sets are one class from the start. Classes that share a signature are candidates; instead of all their pairs,

    1. each is paired with one likely centre per signature (``stars``); pairs that size or bitmap rule out go, the closest
       centre of each class is verified, and components are formed;
    2. pairs of step 1 that join different components, and, in signatures whose members still belong to different
       components, the pairs across components that bitmaps do not rule out (``across``), are verified.

    A pair left out was already connected, so no component is lost and no group is expanded into all its pairs. A
    signature of very many documents is dealt to several tasks by a salt; the centres of the parts are then linked.

    A null or blank text has no shingles and links with nothing: its root is null and its component its own id. Fewer
    words than ``words`` make one shingle. Repeated rows give repeated rows. Ids need not be unique; a component's id is
    the smallest id in it, null if all are null. An empty table gives an empty result; other columns are not read.
    """
    described = materialize(describe(docs, id_col, text_col, words, sketch_bits), "ngram-sets")
    rows = described.filter(F.col("n_shingles").isNotNull()).drop("sketch")
    classes = materialize(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("check").alias("low"), F.max("check").alias("high"),
        F.min("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits")), "ngram-classes")
    if not classes.filter(F.col("low") != F.col("high")).isEmpty():
        raise RuntimeError("two sets share a 64-bit key")
    signer = Signer(frequencies(described.filter(F.col("sketch").isNotNull()), sketch_bits), percent, hot_rows)
    linking = lambda pairs: verify(pairs, docs, classes, id_col, text_col, words, percent, min(block, PARTNERS))

    members = materialize(stars(signatures(docs, text_col, words, signer)), "ngram-members")
    heads = members.filter(F.col("salt") >= 0).select(
        "sig", F.lit(-1).alias("salt"), F.col("pivot").alias("key"), F.col("pivot_n").alias("n"), F.lit(0).alias("rare")).distinct()
    starred = members.unionByName(stars(heads)).filter((F.col("key") != F.col("pivot")) & _sizes_fit("n", "pivot_n", percent))
    close = materialize(likely(starred.select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), classes, percent), "ngram-likely")
    nearest = close.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("p")).select("a", F.col("p.b").alias("b"))
    first = materialize(linking(materialize(nearest, "ngram-nearest")), "ngram-links")
    known = materialize(connected(first).select(F.col("node").alias("key"), "root"), "ngram-known")
    few = small_side(known, SMALL_ROWS)
    root_of = lambda s: few.select(F.col("key").alias(s), F.col("root").alias(f"root_{s}"))
    with_roots = lambda pairs: pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        "a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))

    # the same set may stand in two parts of a salted signature only by way of two tasks; comparing it twice does no harm
    placed = materialize(members.filter("several").select("sig", "key", "n").join(few, "key", "left").withColumn(
        "root", F.coalesce("root", "key")), "ngram-placed")
    mixed = placed.groupBy("sig").agg(F.count(F.lit(1)).alias("all"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter(
        (F.col("all") > 2) & (F.col("_low") != F.col("_high"))).select("sig", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    mixed = small_side(materialize(mixed, "ngram-mixed"), SMALL_ROWS)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    spread = placed.join(mixed, "sig").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "n", "root")
    open_ = with_roots(close.join(nearest, ["a", "b"], "left_anti")).filter(F.col("root_a") != F.col("root_b")).select("a", "b")
    pairs = across(spread.join(classes.select("key", "bits"), "key"), percent).unionByName(open_.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    second = linking(materialize(pairs, "ngram-across"))
    later = connected(with_roots(second).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(
        F.col("node").alias("root"), F.col("root").alias("final"))

    settled = classes.select("key", "least").join(known, "key", "left").withColumn("root", F.coalesce("root", "key")).join(later, "root", "left").select(
        "key", "least", F.coalesce("final", "root").alias("root"))
    settled = materialize(settled, "ngram-roots")
    least = settled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = settled.join(least, "root").select(F.col("key").alias("_key"), "root", "component_id")
    return rows.join(found, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "text_key", "n_shingles", "key", "root",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, unchanged: the one with the smallest id, then the smallest text hash; of equal
    rows one. Documents without shingles all stay."""
    linked = materialize(link(docs, id_col, text_col, **options), "ngram-linked")
    counted = linked.filter(F.col("root").isNotNull()).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"), "rows")
    first = counted.groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.id").alias("_id"), F.col("p.text").alias("_text"), F.col("p.rows").alias("_rows"))
    blank = linked.filter(F.col("root").isNull()).select("doc_id", "text_key", F.lit(1).cast("bigint")).distinct()
    chosen = materialize(first.union(blank), "ngram-chosen")
    keyed = wrapped(docs, id=F.col(id_col).cast("bigint"), text=F.xxhash64(text_of(text_col)))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))
    kept = keyed.join(chosen.filter(F.col("_rows") == 1), on, "left_semi").select("row.*")
    repeated = chosen.filter(F.col("_rows") > 1)
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, on).dropDuplicates(["id", "text"]).select("row.*"))
    return kept
