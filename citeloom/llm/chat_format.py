"""Chat formatting of reply trees, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.llm.common import materialize

OPEN, ROLE_END, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mark turns in this or other common templates; inside texts each is broken by the escape character.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "<start_of_turn>", "<end_of_turn>")
ESCAPE = "\\"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double the escape character, then put one after the first character of every control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    """Undo ``escape``: an escape character stands for what follows it."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def reply_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``tree, leaf, path_rank, node, depth`` with a row per path and node.

    ``nodes(tree, node, parent, score)``: a node without a parent, or whose parent is missing, is a root; ``node`` is
    unique in its tree. The score of a path is the sum over its nodes. Paths of a tree are ranked by score, highest
    first, then by the smaller leaf, and the ``best`` first are given.

    Each self-join doubles the reach: round r knows for each node its ancestor 2**r steps up and the score on the way,
    so a path of d nodes takes log2 d joins, not d. The tables of the rounds then list the ancestors of the chosen
    leaves, again by doubling. Only ids and scores move; texts join once, at the end.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    linked = nodes.join(known, same("tree", "_t") & (F.col("parent") == F.col("_n")), "left").select(
        "tree", "node", F.col("_n").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.col("score").cast("double").alias("sum"))
    rounds = [materialize(linked, "chat-round")]
    while not rounds[-1].filter(F.col("up").isNotNull()).isEmpty():
        if len(rounds) > 48:  # no path is 2 ** 48 nodes long
            raise ValueError("a node of a reply tree is its own ancestor")
        now = rounds[-1]
        going = now.filter(F.col("up").isNotNull())  # ways that have met their root are not joined again
        other = now.select(*[F.col(c).alias(f"_{c}") for c in now.columns])
        longer = going.join(other, same("tree", "_tree") & (F.col("up") == F.col("_node"))).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("sum") + F.col("_sum")).alias("sum"))
        rounds.append(materialize(longer.unionByName(now.filter(F.col("up").isNull())), "chat-round"))
    full = rounds[-1]  # every way ends at its root: steps is the depth, sum the score of the path
    inner = linked.filter(F.col("up").isNotNull()).select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = full.join(inner, same("tree", "_t") & (F.col("node") == F.col("_n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("sum").desc(), "node"))
    chosen = leaves.withColumn("path_rank", rank).filter(F.col("path_rank") <= best)
    paths = materialize(chosen.select("tree", F.col("node").alias("leaf"), "path_rank", "node", F.col("steps").alias("depth")), "chat-paths")
    for r in range(len(rounds) - 2, -1, -1):
        jump = rounds[r].filter(F.col("up").isNotNull()).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        above = paths.join(jump, same("tree", "_t") & (F.col("node") == F.col("_n"))).select(
            "tree", "leaf", "path_rank", F.col("up").alias("node"), (F.col("depth") - (1 << r)).alias("depth"))
        paths = materialize(paths.unionByName(above), "chat-paths")  # written, for the plan would double each round
    return paths


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """One conversation per path: ``tree, leaf, path_rank, formatted, loss_mask``.

    ``texts(tree, node, role, text)``; null roles and texts are empty. ``loss_mask`` is array<struct<start,end>> in code
    points of ``formatted``, the stretches of the assistant's texts, in order.
    """
    content = texts.select(F.col("tree").alias("_t"), F.col("node").alias("_n"),
                           F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(content, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    turns = rows.select("tree", "leaf", "path_rank", F.struct(
        "depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("turn"))
    gathered = turns.groupBy("tree", "leaf", "path_rank").agg(F.sort_array(F.collect_list("turn")).alias("_turns"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))
    mask = F.aggregate("_turns", zero, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
        F.when(t["loss"], F.concat(acc["mask"], F.array(F.struct(
            (acc["at"] + F.length(t["head"])).alias("start"),
            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(acc["mask"]).alias("mask")),
        lambda acc: acc["mask"])
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return gathered.select("tree", "leaf", "path_rank", text.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array<struct<role,text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>", -1)
    whole = F.filter(pieces, lambda p, i: p.startswith(OPEN))
    return F.transform(whole, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, F.length(p)), ROLE_END, 1)).alias("role"),
        unescape(F.regexp_extract(p, r"^[\s\S]*?<\|im_sep\|>([\s\S]*)$", 1)).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def linear_nodes(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Turns of plain conversations as reply trees in which each turn answers the one before:
    ``tree, node, parent, score, role, text``. Nodes are numbered by turn; turns that tie go by role and text."""
    order = Window.partitionBy(tree_col).orderBy(turn_col, role_col, text_col)
    return rows.select(F.col(tree_col).alias("tree"), F.row_number().over(order).cast("bigint").alias("node"),
                       F.lit(1.0).alias("score"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1))


def format_trees(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` conversations of each reply tree, formatted: ``tree, leaf, path_rank, formatted, loss_mask``.

    ``nodes(tree, node, parent, score, role, text)``. Null trees are one tree of their own, null scores count 0, null
    roles and texts are empty. A node given twice is used once. An empty table gives an empty result; other columns are
    not read. A conversation is one row, so its turns meet in one task; trees are independent.
    """
    clean = materialize(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text")
                        .dropDuplicates(["tree", "node"]), "chat-nodes")
    return format_paths(reply_paths(clean, best), clean)
