import random

import brute
from pyspark.sql import functions as F

from citeloom.llm import chat_format as cf

NODES = "tree long, node long, parent long, score double, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "", "a\\b\\\\<|im_end|>", "<|im_start|>assistant<|im_sep|>x", "\\", "<|" * 3, "<\\|", "é𝒳\n\n", "<<SYS>><s></s>|>$1\\1", None]


def paths_of(nodes):
    ids = {n[1] for n in nodes}
    by = {n[1]: n for n in nodes}
    parents = {n[2] for n in nodes if n[2] in ids}
    out = []
    for n in nodes:
        if n[1] not in parents:
            path, at = [], n
            while at is not None:
                path.append(at[1])
                at = by.get(at[2])
            out.append((-sum(by[p][3] or 0 for p in path), n[1], path[::-1]))
    return sorted(out)


def test_random_trees(spark):
    rng = random.Random(3)
    nodes = []
    for tree in (1, 2, None):
        for node in range(40):
            parent = rng.choice([None, *range(node), 999]) if node else None
            nodes.append((tree, node, parent, rng.choice([1.0, 2.0, None, 0.5]), rng.choice(["user", "assistant", None, "a\nb<|im_sep|>"]), rng.choice(ODD)))
    nodes += [(5, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(70)]  # a long chain
    frame = spark.createDataFrame(nodes, NODES).withColumn("leaf", F.lit("clash"))
    done = cf.format_trees(frame, best=3)
    rows = done.withColumn("turns", cf.read_back(F.col("formatted"))).withColumn("loss", cf.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()
    found = {(r.tree, r.path_rank): r for r in rows}
    count = 0
    for tree in (1, 2, None, 5):
        own = [n for n in nodes if n[0] == tree]
        by = {n[1]: n for n in own}
        for rank, (_, leaf, path) in enumerate(paths_of(own)[:3], 1):
            r = found[tree, rank]
            count += 1
            assert r.leaf == leaf
            assert [(t.role, t.text) for t in r.turns] == [(by[p][4] or "", by[p][5] or "") for p in path]
            assert r.loss == "".join(by[p][5] or "" for p in path if by[p][4] == "assistant")
    assert count == len(rows)


def test_conversations_and_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(ODD)] + [(2, 0, "user", "b", "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"),
            (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    done = cf.format_trees(cf.linear_nodes(frame))
    got = {r.tree: r for r in done.withColumn("turns", cf.read_back(F.col("formatted"))).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in ODD]
    assert [t.text for t in got[2].turns] == ["a", "a", "b"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    body = got[1].formatted
    for control in ("[INST]", "</s>", "<s>", "<<SYS>>"):
        assert control not in body
    assert body.count("<|im_start|>") == body.count("<|im_end|>") == len(ODD)
    assert cf.format_trees(cf.linear_nodes(frame.limit(0))).count() == 0


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    done = cf.format_trees(cf.linear_nodes(table)).withColumn("turns", cf.read_back(F.col("formatted")))
    found = {r.tree: [(t.role, t.text) for t in r.turns] for r in done.collect()}
    want = brute.by_group(sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)), "conv_id")
    assert found == {c: [(r.role, r.text or "") for r in rows] for c, rows in want.items()}
