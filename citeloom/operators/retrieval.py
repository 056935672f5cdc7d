"""Batch retrieval: exact vector and keyword top-k, rank fusion, hydration.

Exact scoring has to meet every query with every candidate. That work is laid out as a grid: queries are
hashed into blocks of bounded size, candidates into slices of bounded size, and each (block, slice) cell is
one co-group that returns only its own best k. Nothing is broadcast, no cell grows with the data, and a
word or cluster that holds a third of all rows is spread over all slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from citeloom.functions.text import index_length, index_tokens, query_terms
from citeloom.session import materialize

RANK_DIGITS = 9  # scores are compared after rounding to this many digits, then by id
# One keyword cell scores at most about BLOCK_ROWS x SLICE_ROWS pairs as doubles: 64 MB. Wider blocks copy candidates less often.
BLOCK_ROWS = 1024
SLICE_ROWS = 8192
FEW_SLICES = 64  # slices that are all scored rather than bounded
# Vectors: a slice is copied once per block of queries, so blocks are wide; a cell is scored a few queries at a time.
VECTOR_BLOCK_ROWS = 8192
CELL_SCORES = 2 << 20  # scores of a cell held at once, as doubles: 16 MB
SLICE_NUMBERS = 4 << 20  # components of a slice's vectors, as doubles: 32 MB

# Keyword weighting and rank fusion.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF_CONSTANT = 60


def keep_first(rows: DataFrame, partition: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per partition with ``rank0`` counted from 0.

    The filter is on the bare row number, the form in which Spark drops surplus rows before the shuffle.
    """
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
    return numbered.filter(F.col("_row") <= k).withColumn("rank0", F.col("_row") - 1).drop("_row")


def rank_hits(scored: DataFrame, k: int, qid: str = "qid", item: str = "id", score: str = "score") -> DataFrame:
    """Best ``k`` rows per query, ``rank0`` counted from 0; ties by item id."""
    return keep_first(scored, qid, [F.round(F.col(score), RANK_DIGITS).desc(), F.col(item).asc()], k)


def _cut_hits(packed: DataFrame, k: int) -> DataFrame:
    """packed(qid, hits) → qid, hits: one list per query of the best ``k`` of all its lists, structs (o, id, score) in rank order."""
    every = packed.groupBy("qid").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    keyed = F.transform("hits", lambda h: F.struct((-F.round(h["score"], RANK_DIGITS)).alias("o"), h["id"].alias("id"), h["score"].alias("score")))
    return every.select("qid", F.slice(F.sort_array(keyed), 1, k).alias("hits"))


def merge_hits(packed: DataFrame, k: int) -> DataFrame:
    """packed(qid, hits array<struct<id, score>>), lists of parts of the documents → qid, id, score, rank0 of the best ``k``."""
    rows = _cut_hits(packed, k).select("qid", F.posexplode("hits").alias("rank0", "h"))
    return rows.select("qid", "h.id", "h.score", "rank0")


def pack_hits(packed: DataFrame, k: int) -> DataFrame:
    """packed(qid, hits) → the same with one list of ``k`` per query."""
    return _cut_hits(packed, k).select("qid", F.transform("hits", lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score"))).alias("hits"))


def _cells(queries: DataFrame, items: DataFrame, slice_rows: int, block_rows: int) -> tuple[int, int]:
    """Grid size from two row counts (a number each, not rows)."""
    n_items, n_queries = items.count(), queries.count()
    width = max(1, math.ceil(n_items / slice_rows))
    workers = items.sparkSession.sparkContext.defaultParallelism
    slices = max(width, min(workers, math.ceil(n_items / 500)))
    return max(1, slices), max(1, math.ceil(n_queries / block_rows))


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k scores, ties by id, without sorting everything."""
    keys = np.round(scores, RANK_DIGITS)
    if len(keys) > k:
        floor = np.partition(keys, len(keys) - k)[len(keys) - k]
        keep = np.flatnonzero(keys >= floor)
    else:
        keep = np.arange(len(keys))
    return keep[np.lexsort((ids[keep], -keys[keep]))[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; a null vector, a null component or another width is an error, not a shift of all that follow."""
    widths = pa.compute.unique(pa.compute.list_value_length(column)).to_pylist()
    flat = column.combine_chunks().flatten()
    if len(widths) != 1 or widths[0] is None or flat.null_count:
        raise ValueError(f"vectors must be present and of one width, found widths {widths}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, widths[0])


def _hit_table(qids, ids, scores, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate(qids) if qids else [], schema.field(0).type),
            pa.array(np.concatenate(ids) if ids else [], schema.field(1).type),
            pa.array(np.concatenate(scores) if scores else [], pa.float64()),
        ],
        schema=schema,
    )


def _hit_schemas(queries: DataFrame, items: DataFrame) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("id", items.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    return schema, to_arrow_schema(schema)


def _best_of_rows(grid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best ``k`` scores of every row in rank order, ties by column; like ``_best``, all rows at once."""
    # the k-th best of a share of the columns leaves few of the others
    share = max(4 * k, grid.shape[1] // 8)
    floor = np.partition(grid[:, :share], share - k, axis=1)[:, share - k]
    row, column = np.nonzero(grid >= (floor - 2 * 10.0**-RANK_DIGITS)[:, None])
    order = np.lexsort((-np.round(grid[row, column], RANK_DIGITS), row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(grid)))[row]
    return row[place < k], column[place < k]


def vector_kernel(k: int, metric: str, schema: pa.Schema, cell_scores: int = CELL_SCORES):
    """Scores of one cell by matrix products of at most ``cell_scores`` scores each; higher is better for both metrics.

    ``schema`` asks for a row per hit, or for a row per query with the list ``hits``.
    """
    packed = "hits" in schema.names

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = right["item"].combine_chunks()
        by_id = pyarrow.compute.array_sort_indices(ids, null_placement="at_start")
        ids = ids.take(by_id)
        v = _points(_matrix(right["item_vector"].take(by_id)), metric)
        # in narrow cells a share of the columns tells nothing
        wide = len(ids) > 8 * k and np.isfinite(v).all()
        out_q, out_i, out_s = [], [], []
        step = max(1, cell_scores // len(ids))
        for start in range(0, left.num_rows, step):
            q = _points(_matrix(left["vector"].slice(start, step)), metric)
            grid = q @ v.T
            if metric != "cosine":
                grid *= -2
                grid += (q * q).sum(1)[:, None]
                grid += (v * v).sum(1)[None, :]
                np.negative(np.sqrt(np.maximum(grid, 0, out=grid), out=grid), out=grid)
            if wide and np.isfinite(q).all():
                row, column = _best_of_rows(grid, k)
            else:
                best = [_best(scores, np.arange(len(ids)), k) for scores in grid]
                row, column = np.repeat(np.arange(len(grid)), [len(x) for x in best]), np.concatenate(best)
            out_q.append(row + start)
            out_i.append(column)
            out_s.append(grid[row, column])
        row, items, scores = np.concatenate(out_q), ids.take(pa.array(np.concatenate(out_i))), pa.array(np.concatenate(out_s))
        qids = left["qid"].combine_chunks()
        if not packed:
            return pa.Table.from_arrays([qids.take(pa.array(row)), items, scores], schema=schema)
        held = schema.field("hits").type
        starts = pa.array(np.searchsorted(row, np.arange(left.num_rows + 1)).astype(np.int32))
        hits = pa.StructArray.from_arrays([items, scores], fields=list(held.value_type))
        return pa.Table.from_arrays([qids, pa.ListArray.from_arrays(starts, hits, type=held)], schema=schema)

    return score


def packed_schema(qid: T.StructField, item: T.DataType) -> T.StructType:
    """qid, hits: a query with a list of hits."""
    hit = T.StructType([T.StructField("id", item), T.StructField("score", T.DoubleType())])
    return T.StructType([T.StructField("qid", qid.dataType), T.StructField("hits", T.ArrayType(hit))])


def vector_topk(
    queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine",
    slice_rows: int = SLICE_ROWS, block_rows: int = VECTOR_BLOCK_ROWS, few: int = FEW_SLICES,
    seen: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Exact nearest items: queries(qid, vector), items(id, vector) → qid, id, score, rank0.

    Up to ``few`` slices of items are all scored in one go. Beyond that slices are cells around pivots, and distances
    between queries and pivots rule out most of them (``_pruned_topk``, which also calls ``seen``). Where queries alone
    keep all workers busy, slices are as wide as a task's memory allows, as each returns a list per query.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slices, blocks = _cells(queries, items, slice_rows, block_rows)
    if slices > few:
        return _pruned_topk(queries, items, k, metric, slices, slice_rows, seen)
    if blocks > 1:
        n_items, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        workers = items.sparkSession.sparkContext.defaultParallelism
        widest = max(slice_rows, SLICE_NUMBERS // max(1, width or 1))
        slices = min(slices, max(math.ceil(n_items / widest), math.ceil(3 * workers / blocks)))
    schema = packed_schema(queries.schema["qid"], items.schema["id"].dataType)
    # Fresh column names: both sides may come from the same table.
    right = items.select(F.col("id").alias("item"), F.col("vector").alias("item_vector"), _bucket("id", slices).alias("slice"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = queries.select("qid", "vector", _bucket("qid", blocks).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    keys, tasks = ("block", "slice"), 4 * blocks * slices
    if blocks > 1:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    packed = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(vector_kernel(k, metric, to_arrow_schema(schema)), schema)
    return merge_hits(packed, k)


# Pivots, and the bounds of the rings around them, are sent to every task; so many of each at most.
MOST_PIVOTS, MOST_RINGS = 4096, 16
ASKING_ROWS = 65_536  # queries that meet one slice in one task
FIRST_SLICES = 2
_REACH_SLACK = 1e-7  # distances are rounded sums; a bound must not lose a hit to that


def _points(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Points whose distances order items as the metric does: unit vectors for the cosine."""
    if metric != "cosine":
        return vectors
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] - 2 * (points @ pivots.T) + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(squares, 0))


def _pick_pivots(items: DataFrame, n: int, metric: str) -> np.ndarray:
    """``n`` vectors of items with the smallest hashes: the same whatever the partitioning, and never more than that."""
    rows = items.select("vector").orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(n).collect()
    return _points(np.array([r["vector"] for r in rows], np.float64), metric)


def _near_pivots(items: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """items(item, item_vector) with the pivot nearest to each, the distance to it, and whether the vector has a direction,
    without which no distance tells its cosine."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = items.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*items.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType()),
                           T.StructField("solid", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = _points(_matrix(pa.chunked_array([batch.column("item_vector")])), metric)
                away = _distances(points, shared.value)
                best = away.argmin(1)
                solid = np.full(len(best), True) if metric != "cosine" else points.any(1)
                made = [pa.array(best.astype(np.int32)), pa.array(away[np.arange(len(best)), best]), pa.array(solid)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *made], arrow)], schema=arrow)

    return items.mapInArrow(run, schema)


def _reachable(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, k: int, metric: str) -> DataFrame:
    """qid, cell, least, place: the cells that may hold one of a query's ``k`` nearest, as far as distances to pivots tell.

    ``cells`` has rows (pivot, near, far, n), n without vectors that have no direction. A cell's items are all within away + far, so the nearest cells that hold ``k``
    items bound the k-th distance; a cell whose least distance is beyond that is left out at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells))
    schema = T.StructType([queries.schema["qid"], *T._parse_datatype_string("cell int, least double, place int").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        centre, table = shared.value
        pivot, near, far, n = table[:, 0].astype(np.int64), table[:, 1], table[:, 2], table[:, 3]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                points = _points(_matrix(pa.chunked_array([batch.column("vector")])), metric)
                away = _distances(points, centre)[:, pivot]
                least = np.maximum(np.maximum(away - far, near - away), 0)
                within = away + far
                order = np.argsort(within, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k
                first = np.where(enough.any(1), enough.argmax(1), len(n) - 1)
                rows = np.arange(len(order))
                known = enough.any(1) & (points.any(1) if metric == "cosine" else True)
                limit = np.where(known, within[rows, order[rows, first]], np.inf)
                q, cell = np.nonzero(least <= limit[:, None] + _REACH_SLACK)
                place = np.argsort(np.argsort(least + 1e-9 * away, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(
                    [batch.column("qid").take(pa.array(q)), pa.array(cell.astype(np.int32)), pa.array(least[q, cell]), pa.array(place[q, cell].astype(np.int32))], arrow)], schema=arrow)

    return queries.select("qid", "vector").mapInArrow(run, schema)


def _pruned_topk(queries: DataFrame, items: DataFrame, k: int, metric: str, slices: int, slice_rows: int,
                 seen: Callable[[DataFrame], None] | None) -> DataFrame:
    """Exact search that skips slices. By the triangle inequality no item of a slice is nearer to a query than the query's
    distance to the pivot less the slice's reach, nor nearer than the slice's least distance less that of the query. Each
    query first meets its nearest slices; the k-th best found there is a threshold, and only slices that may hold better are
    met after. Items move once per phase, whatever the number of queries; lists of ``k`` are cut in each slice and
    again in each task before they are merged.
    """
    schema, arrow = _hit_schemas(queries, items)
    pivots = _pick_pivots(items, min(MOST_PIVOTS, slices), metric)
    placed = materialize(_near_pivots(items.select(F.col("id").alias("item"), F.col("vector").alias("item_vector")), pivots, metric), "placed-items")
    # a crowded cell is cut into rings around its pivot, so that rings differ in their distances, and rings into cuts
    counts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    rings = counts.select("pivot", F.least(F.ceil(F.col("n") / slice_rows), F.lit(MOST_RINGS)).cast("int").alias("rings"), "low", "high")
    share = (F.col("away") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300))
    ringed = placed.join(F.broadcast(rings), "pivot").withColumn("ring", F.least(F.floor(share * F.col("rings")).cast("int"), F.col("rings") - 1))
    found = ringed.groupBy("pivot", "ring").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n"), F.count_if("solid").alias("solid")).collect()
    numbers = items.sparkSession.createDataFrame([(r["pivot"], r["ring"], c, math.ceil(r["n"] / slice_rows)) for c, r in enumerate(found)], "pivot int, ring int, cell int, cuts int")
    ringed = ringed.join(F.broadcast(numbers), ["pivot", "ring"]).select(
        "item", "item_vector", "cell", F.pmod(F.xxhash64("item"), F.col("cuts")).cast("int").alias("cut"))
    cells = np.array([(r["pivot"], r["near"], r["far"], r["solid"]) for r in found], np.float64).reshape(-1, 4)
    reached = materialize(_reachable(queries, pivots, cells, k, metric), "reached-cells")

    def meet(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(F.broadcast(numbers.select("cell", "cuts")), "cell").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        crowd = materialize(wide.groupBy("cell", "cut").agg(F.ceil(F.count(F.lit(1)) / ASKING_ROWS).cast("int").alias("groups")), "asked-slices")
        keys = ("cell", "cut", "group")
        left = wide.join(crowd, ["cell", "cut"]).withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).join(
            queries.select("qid", "vector"), "qid").select("qid", "vector", *keys)
        right = ringed.join(crowd, ["cell", "cut"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
            "item", "item_vector", *(F.col(c).alias(f"_{c}") for c in keys))
        return left.groupBy(*keys).cogroup(right.groupBy(*(f"_{c}" for c in keys))).applyInArrow(vector_kernel(k, metric, arrow), schema)

    first = reached.filter(F.col("place") < FIRST_SLICES)
    hits = materialize(meet(first), "first-hits")
    # a score as a distance between points
    apart = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) if metric == "cosine" else -F.col("score")
    kth = rank_hits(hits, k).filter(F.col("rank0") == k - 1).select("qid", (apart + _REACH_SLACK).alias("reach"))
    rest = reached.filter(F.col("place") >= FIRST_SLICES).join(kth, "qid", "left").filter(F.col("reach").isNull() | (F.col("least") <= F.col("reach")))
    rest = materialize(rest.select("qid", "cell"), "open-cells")
    if seen:
        seen(first.select("qid", "cell").unionByName(rest))
    return rank_hits(hits if rest.isEmpty() else hits.unionByName(meet(rest)), k)


# ---------------------------------------------------------------- keyword index

def document_words(docs: DataFrame) -> DataFrame:
    """docs(id, text) → id, words, dl (length in words)."""
    return docs.select("id", index_tokens(F.col("text")).alias("words")).withColumn("dl", F.size("words"))


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per (document, word): id, term, tf, dl. A vocabulary(term) prunes before the shuffle."""
    # The outer form keeps the optimizer from adding a size() filter that would tokenise every text twice.
    words = document_words(docs).select("id", "dl", F.explode_outer("words").alias("term")).filter(F.col("term").isNotNull())
    if vocabulary is not None:
        words = words.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return words.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def term_statistics(post: DataFrame) -> DataFrame:
    """Document frequency and total occurrences per word."""
    return post.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf")
    )


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents and mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(index_length(F.col("text"))).alias("avg_dl"))


def bm25_weight(tf: Column, dl: Column, df: Column, n_docs: Column, avg_dl: Column) -> Column:
    """Floored idf times saturated, length-normalised term frequency."""
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def bm25_weights(post: DataFrame, stats: DataFrame) -> DataFrame:
    """Contribution of each (document, word)."""
    # One subquery for both numbers: it reads every document once.
    means = stats.select(F.struct(F.col("n_docs").cast("double").alias("n_docs"), "avg_dl")).scalar()
    n_docs, avg_dl = means["n_docs"], means["avg_dl"]
    # Counting by tf keeps both uses of the postings identical, so their shuffle is planned once and reused.
    df = post.groupBy("term").agg(F.count_if(F.col("tf") > 0).cast("double").alias("df"))
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), n_docs, avg_dl)
    return post.join(df, "term").select("id", "term", weight.alias("weight"))


def query_words(queries: DataFrame, min_chars: int = 3, limit: int | None = None) -> DataFrame:
    """queries(qid, text) → qid, term, times: a word asked twice counts twice."""
    terms = queries.select("qid", F.explode(query_terms(F.col("text"), min_chars, limit)).alias("word"))
    return terms.groupBy("qid", F.lower("word").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("times"))


def keyword_kernel(k: int, schema: pa.Schema):
    """Scores of one cell: one pass per word over the documents and the queries that contain it."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        qids, q_at = np.unique(left["qid"].to_numpy(), return_inverse=True)
        ids, d_at = np.unique(right["id"].to_numpy(), return_inverse=True)
        terms = pa.chunked_array(left["term"].chunks + right["term"].chunks).combine_chunks()
        codes = terms.dictionary_encode().indices.to_numpy()
        q_code, d_code = codes[: left.num_rows], codes[left.num_rows:]
        times, weight = left["times"].to_numpy(), right["weight"].to_numpy()
        order = np.argsort(d_code, kind="stable")
        starts = np.searchsorted(d_code[order], np.arange(codes.max() + 2))
        grid = np.zeros((len(qids), len(ids)))
        for row in range(len(q_code)):
            span = order[starts[q_code[row]]: starts[q_code[row] + 1]]
            grid[q_at[row], d_at[span]] += times[row] * weight[span]
        out_q, out_i, out_s = [], [], []
        for row in range(len(qids)):
            hit = np.flatnonzero(grid[row] > 0)
            best = hit[_best(grid[row][hit], ids[hit], k)]
            out_q.append(np.repeat(qids[row], len(best)))
            out_i.append(ids[best])
            out_s.append(grid[row][best])
        return _hit_table(out_q, out_i, out_s, schema)

    return score


def keyword_topk(words: DataFrame, weights: DataFrame, n_docs: int, n_queries: int, k: int,
                 slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """words(qid, term, times) against weights(id, term, weight) → qid, id, score, rank0."""
    workers = words.sparkSession.sparkContext.defaultParallelism
    slices = max(1, math.ceil(n_docs / slice_rows), min(workers, math.ceil(n_docs / 500)))
    blocks = max(1, math.ceil(n_queries / block_rows))
    schema, arrow = _hit_schemas(words, weights)
    # A posting goes only to the blocks that ask for its word.
    wanted = words.select(_bucket("qid", blocks).alias("block"), "term").distinct()
    right = weights.join(wanted, "term").withColumn("slice", _bucket("id", slices))
    left = words.withColumn("block", _bucket("qid", blocks)).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    hits = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(
        keyword_kernel(k, arrow), schema
    )
    return rank_hits(hits, k)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, min_chars: int = 3, limit: int | None = None) -> DataFrame:
    """Best ``k`` documents per question that share any word with it; docs(id, text), queries(qid, text)."""
    words = query_words(queries, min_chars, limit)
    post = postings(docs, words)
    weights = bm25_weights(post, corpus_statistics(docs))
    return keyword_topk(words, weights, docs.count(), queries.count(), k)


# ---------------------------------------------------------------- fusion

def rrf_fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (ranks from 0), best ``k`` per query.

    Ties keep the order of first appearance: vector rank first, then text rank.
    """
    v = vector_hits.select("qid", "id", F.col("rank0").alias("v_rank"))
    t = text_hits.select("qid", "id", F.col("rank0").alias("t_rank"))

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.col(rank) + constant), F.lit(0.0))

    fused = v.join(t, ["qid", "id"], "full_outer").withColumn("score", part("v_rank") + part("t_rank"))
    order = [F.round("score", 12).desc(), F.col("v_rank").asc_nulls_last(), F.col("t_rank").asc_nulls_last()]
    return keep_first(fused, "qid", order, k)


def cap_hits(k: Column | int, most: int = 50) -> Column:
    """Hit count a request may ask for."""
    return F.least(k if isinstance(k, Column) else F.lit(k), F.lit(most))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk columns for ranked ids; unknown ids drop out, so a query may return fewer rows."""
    return hits.join(chunks, "id")


def hit_projection(hits: DataFrame) -> DataFrame:
    """Response columns of hydrated hits (id, file, page_start, page_end, text, score)."""
    flat = F.regexp_replace(F.col("text"), r"[\s\x{85}\x{a0}]+", " ")
    lower = F.lower("file")
    link = F.when(
        F.col("file").startswith("docs/") & F.col("file").endswith(".md"),
        F.concat(F.lit("/"), F.replace(F.col("file"), F.lit(".md"), F.lit(".html"))),
    ).when(lower.endswith(".pdf"), F.concat(F.lit("/"), "file", F.lit("#page="), F.col("page_start").cast("string")))
    is_figure = F.col("id").cast("string").startswith("fig:")
    badge = F.when(is_figure, "figure").when(F.col("file").startswith("docs/"), "research doc").otherwise("source")
    kept = [c for c in ("qid", "rank0") if c in hits.columns]
    return hits.select(
        *kept, "id", "file", "page_start", "page_end", F.round("score", 5).alias("score"),
        F.substring(flat, 1, 400).alias("snippet"), flat.alias("full"),
        is_figure.alias("is_figure"), link.alias("link"), badge.alias("badge"),
    )


TextSearch = Callable[[DataFrame, int], DataFrame]


def hybrid_search(queries: DataFrame, docs: DataFrame | None, vectors: DataFrame, k: int = 12, text_search: TextSearch | None = None) -> DataFrame:
    """queries(qid, text, vector), docs(id, text), vectors(id, vector) → fused best ``k`` per query.

    ``text_search`` asks a built keyword index; without one ``docs`` is indexed for this search alone.
    """
    depth = 3 * k
    by_vector = vector_topk(queries.filter(F.col("vector").isNotNull()).select("qid", "vector"), vectors, depth)
    asked = queries.select("qid", "text")
    by_text = text_search(asked, depth) if text_search else bm25_topk(asked, docs, depth)
    return rrf_fuse(by_vector, by_text, k)


def context_block(hits: DataFrame, chars: int | None = None) -> DataFrame:
    """Numbered passages of each query in rank order: ``[1] (file p.N) text``, joined by an empty line.

    Texts are whole, or cut to ``chars`` for a model with a small window.
    """
    where = F.concat(
        F.col("file"), F.when(F.coalesce(F.col("page_start"), F.lit(0)) != 0,
                              F.concat(F.lit(" p."), F.col("page_start").cast("string"))).otherwise(F.lit(""))
    )
    flat = F.regexp_replace("text", r"[\s\x{85}\x{a0}]+", " ")
    flat = flat if chars is None else F.substring(flat, 1, chars)
    rows = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank0", where.alias("w"), flat.alias("t")))).alias("p"))
    lines = F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), x["w"], F.lit(") "), x["t"]))
    return rows.select("qid", F.array_join(lines, "\n\n").alias("context"))
