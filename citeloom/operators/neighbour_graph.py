"""Approximate nearest items over a neighbour graph that is refined by neighbours of neighbours (NN-descent).

Nodes are dealt by a hash of their ids to shards of bounded size, so many as they need, and each shard has a graph of its own,
which one task makes and which fits in its memory. It starts from exact neighbours inside small groups around random pivots.
Each round compares the neighbours of every node, to it and from it, with one another, and every node keeps the best it has
found. A search walks the graph of every shard from a few start nodes, a handful of nodes a round, keeping the best found so
far, and the lists of the shards are merged. Lists, groups, beams and shards are bounded; nodes, links and questions move once
for each (shard, block of questions), and nothing is written per node that a question looks at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from citeloom.operators.ann import unit
from citeloom.operators.retrieval import MOST_PIVOTS, _best, _bucket, _matrix, keep_first, merge_hits, packed_schema
from citeloom.session import materialize

NEIGHBOURS = 16
GROUP_ROWS = 256       # items of a start group
STARTS = 2             # ways to form start groups
ROUNDS = 8
SETTLED = 0.001        # share of edges that a round must change to be followed by another
BEAM, EXPAND = 96, 8   # nodes a question keeps, and those whose neighbours it looks at in a round
ENTRIES = 64           # start nodes of a search
SHARD_NUMBERS = 6 << 20  # components of the vectors of a shard, at most: 48 MB as doubles
SHARD_ROWS = 8192      # nodes of a shard, if all workers have one
ASKING_ROWS = 65_536   # questions that meet one shard in one task, at most
LEAST_ASKING = 1024    # so few are not parted
MET_ROWS = 2048        # nodes whose neighbours are compared at once
LOOKED = 8 << 20       # (question, node) marks held at once: 40 MB


def _edge_schema(items: DataFrame) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = items.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])
    return schema, to_arrow_schema(schema)


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group; ``group`` is sorted."""
    return np.arange(len(group)) - np.searchsorted(group, group)


class Lists:
    """The best ``k`` partners of each of ``n`` nodes found so far, best first: ``ids`` (-1 where there is none) and ``scores``."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)

    def take_in(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        """Edges found, maybe twice or known already."""
        new = score > self.scores[a, -1]
        a, b, score = a[new], b[new], score[new]
        new = (self.ids[a] != b[:, None]).all(1)
        a, b, score = a[new], b[new], score[new]
        _, once = np.unique(a.astype(np.int64) * len(self.ids) + b, return_index=True)
        a, b, score = a[once], b[once], score[once]
        order = np.lexsort((-score, a))
        a, b, score = a[order], b[order], score[order]
        place, k = _places(a), self.ids.shape[1]
        a, b, score, place = (x[place < k] for x in (a, b, score, place))
        touched, row = np.unique(a, return_inverse=True)
        more = Lists(len(touched), k)
        more.ids[row, place], more.scores[row, place] = b, score
        ids, scores = (np.hstack([getattr(self, c)[touched], getattr(more, c)]) for c in ("ids", "scores"))
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        self.ids[touched], self.scores[touched] = (np.take_along_axis(x, best, 1) for x in (ids, scores))

    def back(self) -> np.ndarray:
        """Of the nodes that have a node in their lists the best ``k``, -1 where there are fewer."""
        a, at = np.nonzero(self.ids >= 0)
        b, score = self.ids[a, at], self.scores[a, at]
        order = np.lexsort((a, -score, b))
        a, b = a[order], b[order]
        place, out = _places(b), np.full_like(self.ids, -1)
        few = place < out.shape[1]
        out[b[few], place[few]] = a[few]
        return out


def descend(vectors: np.ndarray, k: int, rounds: int, group_rows: int) -> Lists:
    """The graph of one shard from its vectors of length one."""
    n, lists = len(vectors), Lists(len(vectors), k)
    for start in range(STARTS):
        rng = np.random.default_rng(start)
        pivots = vectors[rng.choice(n, min(MOST_PIVOTS, math.ceil(n / group_rows)), replace=False)]
        step = max(1, (2 << 20) // len(pivots))
        pivot = np.concatenate([(vectors[x:x + step] @ pivots.T).argmax(1) for x in range(0, n, step)])
        cuts = np.ceil(np.bincount(pivot, minlength=len(pivots)) / group_rows).astype(np.int64)
        group = pivot * n + rng.integers(0, 1 << 40, n) % cuts[pivot]
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own) > 1:
                grid = vectors[own] @ vectors[own].T
                np.fill_diagonal(grid, -np.inf)
                best = np.argpartition(-grid, min(k, len(own) - 1) - 1, axis=1)[:, :min(k, len(own) - 1)]
                lists.take_in(np.repeat(own, best.shape[1]), own[best.ravel()], np.take_along_axis(grid, best, 1).ravel())
    for _ in range(rounds):
        before, near = lists.ids.copy(), np.hstack([lists.ids, lists.back()])
        for x in range(0, n, MET_ROWS):
            own = near[x:x + MET_ROWS]
            grid = vectors[own]
            grid = grid @ grid.transpose(0, 2, 1)
            # an absent neighbour beats nothing and is nobody's partner
            least = np.where(own >= 0, lists.scores[own, -1], np.inf)
            node, i, j = np.nonzero((grid > least[:, :, None]) & (own >= 0)[:, None, :] & (own[:, :, None] != own[:, None, :]))
            lists.take_in(own[node, i], own[node, j], grid[node, i, j])
        changed = sum(int(((now >= 0) & ~(now[:, :, None] == was[:, None, :]).any(2)).sum()) for now, was in (
            (lists.ids[x:x + MET_ROWS], before[x:x + MET_ROWS]) for x in range(0, n, MET_ROWS)))
        if changed <= SETTLED * n * k:
            break
    return lists


def _nodes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, the table's rows in that order, and where the rows of each id begin. Rows of one id are one node,
    which stands where its first row does."""
    ids = table["id"].combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    known, first = np.unique(ids[order], return_index=True)
    return known, order, np.append(first, len(ids))


def neighbour_graph(items: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, group_rows: int = GROUP_ROWS,
                    shard_numbers: int = SHARD_NUMBERS) -> tuple[DataFrame, DataFrame]:
    """items(id, vector) → nodes(id, vector of length one, shard) and edges(a, b, score), ``k`` a node, by the cosine.

    A shard has at most about ``shard_numbers`` components, and ``SHARD_ROWS`` nodes as long as that keeps no more than all workers
    busy; edges do not leave their shard."""
    nodes = materialize(unit(items).select("id", "vector"), "graph-nodes")
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shards = max(1, math.ceil(n * (width or 1) / shard_numbers), min(items.sparkSession.sparkContext.defaultParallelism, math.ceil(n / SHARD_ROWS)))
    nodes = nodes.withColumn("shard", _bucket("id", shards))
    schema, arrow = _edge_schema(nodes)

    def make(table: pa.Table) -> pa.Table:
        ids, order, starts = _nodes(table)
        vectors = _matrix(table["vector"])[order[starts[:-1]]]
        lists = descend(vectors.astype(np.float32), k, rounds, group_rows)
        a, at = np.nonzero(lists.ids >= 0)
        b = lists.ids[a, at]
        score = np.concatenate([np.einsum("ij,ij->i", vectors[a[x:x + 65_536]], vectors[b[x:x + 65_536]]) for x in range(0, len(a) or 1, 65_536)])
        return pa.Table.from_arrays([pa.array(ids[a], arrow.field(0).type), pa.array(ids[b], arrow.field(1).type), pa.array(score)], schema=arrow)

    edges = nodes.filter(F.col("id").isNotNull()).groupBy("shard").applyInArrow(make, schema)
    return nodes, materialize(edges, "graph-edges")


def walk(vectors: np.ndarray, links: np.ndarray, starts: np.ndarray, asked: np.ndarray, beam: int, expand: int, most_rounds: int) -> np.ndarray:
    """The best ``beam`` nodes that each question finds, -1 where there are fewer.

    In each round a question looks at the neighbours of its best ``expand`` nodes not looked at yet, and keeps the best ``beam``
    of all. It ends when all it keeps have been looked at. ``links`` has a node's own number where it has fewer neighbours."""
    rows, n = len(asked), len(vectors)
    met, last = np.zeros(rows * n, bool), np.empty(rows * n, np.int32)
    held, score = np.full((rows, beam), -1, np.int32), np.full((rows, beam), -np.inf, np.float32)
    seen = np.ones((rows, beam), bool)

    def keep(open_: np.ndarray, row: np.ndarray, node: np.ndarray, found: np.ndarray) -> None:
        """Nodes found by the questions ``open_``, by their place in it, in order."""
        place = _places(row)
        width = int(place.max(initial=-1)) + 1
        more, values = np.full((len(open_), width), -1, np.int32), np.full((len(open_), width), -np.inf, np.float32)
        more[row, place], values[row, place] = node, found
        values = np.hstack([score[open_], values])
        best = np.argpartition(-values, beam - 1, axis=1)[:, :beam] if width else np.tile(np.arange(beam), (len(open_), 1))
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(values, best, 1), axis=1, kind="stable"), 1)
        held[open_] = np.take_along_axis(np.hstack([held[open_], more]), best, 1)
        score[open_] = np.take_along_axis(values, best, 1)
        seen[open_] = np.take_along_axis(np.hstack([seen[open_], more < 0]), best, 1)

    met.reshape(rows, n)[:, starts] = True
    first = asked @ vectors[starts].T
    keep(np.arange(rows), np.repeat(np.arange(rows), len(starts)), np.tile(starts, rows), first.ravel())
    for _ in range(most_rounds):
        open_ = np.flatnonzero(~seen.all(1))
        if not len(open_):
            break
        wait = ~seen[open_]
        row, at = np.nonzero(wait & (np.cumsum(wait, axis=1) <= expand))
        near = links[held[open_[row], at]]
        seen[open_[row], at] = True
        mark = (open_[row].astype(np.int64) * n)[:, None] + near
        mark = mark[~met[mark]]
        # a node that several neighbours name is kept once, where it was written last
        number = np.arange(len(mark), dtype=np.int32)
        last[mark] = number
        mark = mark[last[mark] == number]
        met[mark] = True
        who, node = np.divmod(mark, n)
        ends = np.searchsorted(who, np.append(open_, rows))
        found = np.empty(len(node), np.float32)
        for q, x, y in zip(open_.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            np.dot(vectors[node[x:y]], asked[q], out=found[x:y])
        good = found > score[who, -1]
        keep(open_, np.searchsorted(open_, who[good]), node[good], found[good])
    return held


def _walk_kernel(k: int, beam: int, expand: int, most_rounds: int, schema: pa.Schema):
    """The best ``k`` rows of one shard for each question, a list per question; all kept nodes are scored by double precision."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, order, rows = _nodes(right)
        n, exact, single = len(ids), _matrix(right["vector"]), pa.array(order[rows[:-1]])
        near = right["links"].combine_chunks().take(single)
        size = near.value_lengths().to_numpy(zero_copy_only=False)
        to = near.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, to), n - 1)
        at = np.where(ids[at] == to, at, np.repeat(np.arange(n), size)).astype(np.int32)
        links = np.repeat(np.arange(n, dtype=np.int32)[:, None], max(1, size.max(initial=0)), axis=1)
        links[np.repeat(np.arange(n), size), np.arange(len(to)) - np.repeat(np.cumsum(size) - size, size)] = at
        starts = np.flatnonzero(right["entry"].combine_chunks().take(single).to_numpy(zero_copy_only=False)).astype(np.int32)
        vectors = exact.astype(np.float32)[order[rows[:-1]]]
        step = max(1, min(512, LOOKED // n))
        out_i, out_s = [], []
        for x in range(0, left.num_rows, step):
            asked = _matrix(left["vector"].slice(x, step))
            for own, held in zip(asked, walk(vectors, links, starts, asked.astype(np.float32), beam, expand, most_rounds)):
                held = np.sort(held[held >= 0])
                many = rows[held + 1] - rows[held]
                every = np.repeat(rows[held] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                score = exact[order[every]] @ own
                best = _best(score, every, k)
                out_i.append(np.repeat(held, many)[best])
                out_s.append(score[best])
        ends = np.append(0, np.cumsum([len(x) for x in out_i])).astype(np.int32)
        kind = schema.field("hits").type
        hits = pa.StructArray.from_arrays([pa.array(ids[np.concatenate(out_i)], kind.value_type.field("id").type), pa.array(np.concatenate(out_s))], fields=list(kind.value_type))
        return pa.Table.from_arrays([left["qid"].combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), hits, type=kind)], schema=schema)

    return search


def graph_topk(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, beam: int = BEAM, expand: int = EXPAND, most_rounds: int = 64) -> DataFrame:
    """queries(qid, vector) over a neighbour graph → qid, id, score, rank0, nearly always the true best ``k``.

    In each shard a question starts from the best of ``ENTRIES`` nodes and walks to neighbours in both directions (``walk``).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    asked = materialize(unit(queries.select("qid", "vector")).filter(F.col("qid").isNotNull()), "graph-queries")
    back = keep_first(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"), "a", [F.col("score").desc(), F.col("b")], NEIGHBOURS)
    links = edges.select("a", "b").unionByName(back.select("a", "b")).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("links"))
    here = nodes.filter(F.col("id").isNotNull())
    entries = keep_first(here.select("shard", "id").distinct(), "shard", [F.xxhash64(F.lit(3), "id"), F.col("id")], ENTRIES)
    entries = entries.select(F.col("id").alias("start"), F.lit(True).alias("entry"))  # a fixed number of rows a shard
    linked = here.join(links, here["id"] == links["a"], "left").join(entries, here["id"] == entries["start"], "left").select(
        "shard", "id", "vector", F.coalesce("links", F.array().cast(T.ArrayType(nodes.schema["id"].dataType))).alias("links"),
        F.coalesce("entry", F.lit(False)).alias("entry"))
    linked = materialize(linked, "graph-linked")
    shards = [r[0] for r in linked.select("shard").distinct().collect()]
    n = asked.count()
    workers = asked.sparkSession.sparkContext.defaultParallelism
    wanted = max(math.ceil(n / ASKING_ROWS), math.ceil(3 * workers / max(1, len(shards))))
    blocks = max(1, min(wanted, math.ceil(n / LEAST_ASKING)))
    keys, tasks = ("block", "shard"), 4 * blocks * max(1, len(shards))
    left = asked.withColumn("block", _bucket("qid", blocks)).withColumn(
        "shard", F.explode(F.lit(shards).cast("array<int>"))).repartition(tasks, *keys)
    right = linked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *keys)
    schema = packed_schema(asked.schema["qid"], nodes.schema["id"].dataType)
    kernel = _walk_kernel(k, beam, expand, most_rounds, to_arrow_schema(schema))
    return merge_hits(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema), k)
