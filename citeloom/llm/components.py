"""Connected components by contracting edges, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import materialize
from citeloom.session import small_side

SMALL_ROWS = 1_000_000  # nodes up to which a round's table is broadcast, some 30 MB; larger graphs are joined by shuffles


def connected(edges: DataFrame, seed: int = 4, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; nodes are connected exactly when their roots are equal.

    A round points each node to that neighbour, or itself, whose hash is smallest, then replaces every edge by the
    edge between what its ends point to. A path is shortened by a constant factor on average, whatever its order, as
    each round hashes anew; a star is done in one. Smallest neighbours are found by aggregation before the shuffle, so a
    node with very many neighbours is no burden; the joins that replace ends are ordinary equi-joins that adaptive
    execution can split. Every round is written to the shared folder, which cuts the lineage.
    """
    now = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "graph-edges")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        if len(steps) == most_rounds:
            raise RuntimeError("components did not settle")
        mark = lambda c: F.struct(F.xxhash64(F.lit(seed + len(steps)), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = now.select(F.col("a").alias("node"), mark("b").alias("m")).unionByName(now.select(F.col("b").alias("node"), mark("a").alias("m")))
        near = both.groupBy("node").agg(F.min("m").alias("m"))
        point = materialize(near.select("node", F.least("m", mark("node"))["id"].alias("to")), "graph-step")
        steps.append(point)
        few = small_side(point, SMALL_ROWS)
        left = few.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = few.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = now.join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        now = materialize(moved.filter(F.col("a") != F.col("b")).distinct(), "graph-edges")
    if not steps:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").alias("node"), F.col("a").cast(kind).alias("root")).limit(0)
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        # a node has the root of what it points to; what no later round saw is a root itself
        later = found.select(F.col("node").alias("to"), "root")
        found = materialize(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "graph-roots")
    return found
