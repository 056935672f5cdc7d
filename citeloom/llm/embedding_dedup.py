"""Near-duplicate vectors by product quantisation over inverted lists, with exact cosine rerank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import in_pieces, materialize
from citeloom.llm.components import connected

SIMILARITY = 0.98
SAMPLE = 16_384          # vectors that training reads at most
SAMPLE_BYTES = 64 << 20  # and bytes, whichever is less
VECTORS_PER_CELL, MOST_CELLS = 64, 256
SUBSPACES, CODES = 8, 16
SLICE = 4096             # vectors of a list that one task holds at once
QUERY_BLOCK = 512
ROUGH = 2.0 ** -10 + 2.0 ** -13  # by how much the product of two unit vectors in half precision may miss the true one


@dataclass
class Model:
    """Coarse centres and one residual codebook per subspace."""

    width: int
    centres: np.ndarray       # cells x width
    books: list[np.ndarray]   # per subspace: codes x dimensions
    edges: list[int]          # where subspaces start, and the end

    def apart(self) -> np.ndarray:
        """Distances between centres."""
        c = self.centres
        return np.sqrt(np.maximum(1e-30, (c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None]))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres."""
        return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres * self.centres).sum(1)[None])

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes per subspace, and by how far the coded residual misses the true one."""
        codes = np.empty((len(residual), len(self.books)), dtype=np.uint8)
        missed = np.zeros(len(residual))
        for j, book in enumerate(self.books):
            part = residual[:, self.edges[j]:self.edges[j + 1]]
            far = ((part[:, None, :] - book[None]) ** 2).sum(2)
            codes[:, j] = far.argmin(1)
            missed += far.min(1)
        return codes, np.sqrt(missed)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Per subspace the squared distances from each query to each code."""
        return [((residual[:, None, self.edges[j]:self.edges[j + 1]] - book[None]) ** 2).sum(2) for j, book in enumerate(self.books)]


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    pick = np.random.default_rng(seed)
    centres = x[pick.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)
        for c in range(len(centres)):
            own = x[near == c]
            centres[c] = own.mean(0) if len(own) else x[pick.integers(len(x))]
    return centres


def train(sample: np.ndarray, seed: int = 7) -> Model:
    """Fit centres and codebooks on unit vectors."""
    cells = int(min(MOST_CELLS, max(1, len(sample) // VECTORS_PER_CELL)))
    centres = _kmeans(sample, cells, seed)
    model = Model(sample.shape[1], centres, [], [])
    residual = sample - centres[model.nearest(sample).argmin(1)]
    parts = min(SUBSPACES, sample.shape[1])
    model.edges = [round(i * sample.shape[1] / parts) for i in range(parts + 1)]
    model.books = [_kmeans(residual[:, a:b], CODES, seed + 1 + i) for i, (a, b) in enumerate(zip(model.edges, model.edges[1:]))]
    return model


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, key, width, unit``: the vector scaled to length 1 (binary doubles) and a 128-bit key of label and
    vector. Key and unit are null for vectors that link with nothing."""
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                            F.col(vector_col).cast("array<double>").alias("vector"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths, units = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None
                if label is not None and vector.is_valid and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False)
                    size = np.abs(x).max() if len(x) else 0.0
                    if not (np.isfinite(x).all() and size > 0):
                        x = None
                if x is None:
                    keys.append(None), widths.append(None), units.append(None)
                else:
                    scaled = x / size  # keeps squares in range
                    keys.append(hashlib.md5(label.encode() + b"\0" + x.tobytes()).digest())
                    widths.append(len(x))
                    units.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(widths, pa.int32()), pa.array(units, pa.binary())],
                names=["vec_id", "label", "key", "width", "unit"])

    return source.mapInArrow(prepare, "vec_id bigint, label string, key binary, width int, unit binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="float64").reshape(-1, width)


def _placed(classes: DataFrame, model: Model, similarity: float) -> DataFrame:
    """Index and query rows: ``label, width, cell, role, key, weight, rough, codes, missed, home, asks``.

    Role 0 is the vector in the list of its nearest centre (``home``), role 1 the same vector asking a list. Of two
    vectors within ``reach`` of each other in different cells at least one is within half of that of the plane between both
    centres, as the plane lies between them. So a vector asks the lists whose plane is within half the reach, and a link
    that only one end finds is credited to the other: ``asks`` tells which lists an end asks itself. What travels is the
    vector in half precision (``rough``).
    """
    reach = float(np.sqrt(2 - 2 * similarity))
    margin = reach / 2 + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = model.apart()
        for batch in in_pieces(batches, 256 << 10):  # each vector may be copied to many lists
            width = batch.column(2).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                part = batch.take(pa.array(rows))
                n = len(rows)
                if w != model.width:  # no model for this width: one list, compared exactly
                    own, probes = np.full(n, -1), [(np.arange(n), np.full(n, -1))]
                    codes, missed = [b""] * n, np.zeros(n)
                else:
                    x = _matrix(part.column(3), model.width)
                    far = model.nearest(x)
                    own = far.argmin(1)
                    codes_, missed = model.encode(x - model.centres[own])
                    codes = [c.tobytes() for c in codes_]
                    plane = (far - far[np.arange(n), own][:, None]) / (2 * between[own])
                    plane[np.arange(n), own] = 0
                    probes = [np.nonzero(plane <= margin)]
                asks, cells = probes[0]
                take = pa.array(np.concatenate([np.arange(n), asks]))
                both = part.take(take)
                half = pa.array([h.tobytes() for h in _matrix(part.column(3), int(w)).astype("<f2")], pa.binary()).take(take)
                yield pa.RecordBatch.from_arrays([
                    both.column(1), both.column(2), pa.array(np.concatenate([own, cells]).astype("int32")),
                    pa.array(np.repeat([0, 1], [n, len(asks)]).astype("int32")), both.column(0), both.column(4), half,
                    pa.array(codes + [None] * len(asks), pa.binary()), pa.array(np.concatenate([missed, np.zeros(len(asks))])),
                    pa.array(np.concatenate([own, own[asks]]).astype("int32")),
                    pa.array([c.astype("<i4").tobytes() for c in np.split(cells, np.searchsorted(asks, np.arange(1, n)))] + [None] * len(asks), pa.binary())],
                    names=["label", "width", "cell", "role", "key", "weight", "rough", "codes", "missed", "home", "asks"])

    return classes.select("key", "label", "width", "unit", "weight").mapInArrow(
        place, "label string, width int, cell int, role int, key binary, weight bigint, rough binary, codes binary, missed double, home int, asks binary")


class _List:
    """The vectors of one slice of a list, ready to be asked."""

    def __init__(self, model: Model, cell: int, width: int, similarity: float):
        self.model, self.cell, self.width, self.similarity = model, cell, width, similarity
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * similarity)))
        self.parts: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append((batch.column("key").to_pylist(), batch.column("weight").to_numpy(), batch.column("rough").to_pylist(),
                           batch.column("codes").to_pylist(), batch.column("missed").to_numpy(), batch.column("asks").to_pylist()))

    def close(self) -> None:
        self.keys = [k for p in self.parts for k in p[0]]
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.group = np.arange(len(self.keys))
        if self.keys:
            self.weight = np.concatenate([p[1] for p in self.parts])
            self.rough = np.frombuffer(b"".join(u for p in self.parts for u in p[2]), "<f2").reshape(-1, self.width).astype("float64")
            self.missed = np.concatenate([p[4] for p in self.parts])
            self.credit = np.zeros(len(self.keys), "int64")
            if self.cell >= 0:
                self.codes = np.frombuffer(b"".join(c for p in self.parts for c in p[3]), "uint8").reshape(len(self.keys), -1)
                self.asks = np.zeros((len(self.keys), len(self.model.centres)), bool)
                for i, cells in enumerate(c for p in self.parts for c in p[5]):
                    self.asks[i, np.frombuffer(cells, "<i4")] = True
        self.parts = []

    def credits(self) -> Iterator[tuple[bytes, bytes, int, bool]]:
        """What links found from the other end alone add to the vectors of this slice."""
        if self.keys:
            for i in np.flatnonzero(self.credit).tolist():
                yield self.keys[i], self.keys[i], int(self.credit[i]), True

    def ask(self, keys: list[bytes], x: np.ndarray, home: np.ndarray, weight: np.ndarray) -> Iterator[tuple[bytes, bytes, int, bool]]:
        """(query, linked vector, weight, sure): the weights of a query's rows add up to its links here, and all rows
        together connect what the links connect. A pair so near the bound that half precision cannot tell is not sure and a
        row of its own."""
        if not self.keys:
            return
        if self.cell >= 0:
            near = np.zeros((len(x), len(self.keys)))
            for table, code in zip(self.model.tables(x - self.model.centres[self.cell]), self.codes.T):
                near += table[:, code]
            bound = self.reach + self.missed + ROUGH  # a linked vector's code is never farther
            rows, cols = np.nonzero(near <= (bound * bound)[None])
        else:
            rows, cols = np.nonzero(np.ones((len(x), len(self.keys)), dtype=bool))
        score = np.zeros(len(rows))
        for at in range(0, len(rows), 65_536):
            some = slice(at, at + 65_536)
            score[some] = np.einsum("ij,ij->i", x[rows[some]], self.rough[cols[some]])
        own = np.array([self.place.get(k, -1) for k in keys])
        band = ROUGH + 1e-7 * np.sqrt(self.width)
        alone = ~self.asks[cols, home[rows]] if self.cell >= 0 else np.zeros(len(rows), bool)
        for open_ in np.flatnonzero((np.abs(score - self.similarity) <= band) & (cols != own[rows])).tolist():
            a, b = keys[rows[open_]], self.keys[cols[open_]]
            yield a, b, int(self.weight[cols[open_]]), False
            if alone[open_]:
                yield b, a, int(weight[rows[open_]]), False
        linked = (score > self.similarity + band) & (cols != own[rows])
        np.add.at(self.credit, cols[linked & alone], weight[rows[linked & alone]])
        rows, cols = rows[linked], cols[linked]
        starts = np.searchsorted(rows, np.arange(len(x) + 1))
        for q in range(len(x)):
            found = cols[starts[q]:starts[q + 1]]
            if len(found):
                groups, firsts = np.unique(self.group[found], return_index=True)
                if len(groups) > 1:
                    self.group[np.isin(self.group, groups)] = groups[0]
                total = int(self.weight[found].sum())
                for i, first in enumerate(firsts):
                    yield keys[q], self.keys[found[first]], total if i == 0 else 0, True


def _links(dealt: DataFrame, model: Model, similarity: float) -> DataFrame:
    """``a, b, n, sure`` out of rows sorted by list and role; a task holds one slice of a list and one block of queries."""
    names = dealt.columns

    def made(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.binary(), pa.int64(), pa.bool_()))],
                                             names=["a", "b", "n", "sure"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, closed = None, None, False
        for batch in batches:
            spot = list(zip(*(batch.column(n).to_pylist() for n in ("label", "width", "cell", "slice", "role"))))
            cuts = [0] + [i for i in range(1, len(spot)) if spot[i] != spot[i - 1]] + [len(spot)]
            for a, b in zip(cuts, cuts[1:]):
                part, (label, width, cell, piece, role) = batch.slice(a, b - a), spot[a]
                if (label, width, cell, piece) != at:
                    if closed:
                        yield from made(list(current.credits()))
                    at, current, closed = (label, width, cell, piece), _List(model, cell, width, similarity), False
                if role == 0:
                    current.add(part)
                    continue
                if not closed:
                    current.close()
                    closed = True
                for start in range(0, part.num_rows, QUERY_BLOCK):
                    block = part.slice(start, QUERY_BLOCK)
                    x = np.frombuffer(b"".join(block.column("rough").to_pylist()), "<f2").reshape(-1, width).astype("float64")
                    yield from made(list(current.ask(block.column("key").to_pylist(), x, block.column("home").to_numpy(), block.column("weight").to_numpy())))
        if closed:
            yield from made(list(current.credits()))

    return dealt.select(names).mapInArrow(ask, "a binary, b binary, n bigint, sure boolean")


def _decided(open_: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b, n`` near the bound whose cosine in double precision reaches it; only their vectors are fetched."""
    sides = [classes.select(F.col("key").alias(s), F.col("unit").alias(f"unit_{s}")) for s in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 4 << 20):
            x, y = (batch.column(f"unit_{s}").to_pylist() for s in "ab")
            keep = pa.array([float(np.frombuffer(u, "float64") @ np.frombuffer(v, "float64")) >= similarity for u, v in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "n")], names=["a", "b", "n"])

    return open_.select("a", "b", "n").join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a binary, b binary, n bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    similarity: float = SIMILARITY, slice_size: int = SLICE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: vectors of equal label with a cosine of at least ``similarity`` link.

    Equal vectors of a label become one class with a weight first. Classes go to the list of their nearest coarse
    centre as residual codes, and of two vectors that link at least one asks the other's list (see ``_placed``). A table look-up distance,
    widened by the item's own coding error, rules vectors out without losing any; what is left is compared in half
    precision, and pairs that this cannot decide by cosine in double precision. A list longer than ``slice_size`` is cut into slices, each asked by every query, so no task holds
    a whole hot list. Links are counted, and only a spanning set of them leaves a task.

    The model is fitted on at most ``SAMPLE`` classes and ``SAMPLE_BYTES`` bytes, those of smallest hash; it decides
    speed and recall, all vectors are indexed and ask. Vectors of another width than most are compared exactly.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, have no
    links and are their own component. A component's id is the smallest id in it; null ids are ignored if others exist.
    Repeated rows are separate vectors. An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(_usable(vectors, id_col, vector_col, label_col), "pq-rows")
    usable = rows.filter(F.col("key").isNotNull())
    classes = materialize(usable.groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"),
        F.first("width").alias("width"), F.first("unit").alias("unit")), "pq-classes")
    widths = classes.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    alone = F.col("vec_id").alias("component_id")
    if widths is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), alone, F.lit(True).alias("kept"))
    width = int(widths["width"])
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = classes.filter(F.col("width") == width).orderBy(F.xxhash64("key"), "key").limit(most).select("unit").collect()
    model = train(np.frombuffer(b"".join(bytes(r[0]) for r in sample), "float64").reshape(-1, width))

    placed = materialize(_placed(classes, model, similarity), "pq-lists")
    spot = ["label", "width", "cell"]
    sizes = placed.filter(F.col("role") == 0).groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("slices"))
    sized = placed.join(sizes, spot)  # a list without vectors is not asked
    dealt = sized.withColumn("slice", F.explode(F.when(
        F.col("role") == 0, F.array(F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))))
    dealt = dealt.repartition(*spot, "slice").sortWithinPartitions(*spot, "slice", "role")
    made = materialize(_links(dealt, model, similarity), "pq-pairs")
    links = materialize(made.filter("sure").select("a", "b", "n").unionByName(_decided(made.filter(~F.col("sure")), classes, similarity)), "pq-links")

    counts = links.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("_a"), "n")
    roots = connected(links.select("a", "b")).select(F.col("node").alias("_node"), "root")
    facts = materialize(classes.select("key", "least", "weight").join(counts, F.col("key") == F.col("_a"), "left").join(
        roots, F.col("key") == F.col("_node"), "left").select(
        "key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "pq-facts")
    least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = facts.join(least, "root").select(F.col("key").alias("_key"), "n_links", "component_id")
    joined = rows.select("vec_id", "key").join(by_key, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
