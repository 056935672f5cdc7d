import brute
import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, least=0.98):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            unit[k] = (label, x / np.linalg.norm(x))
    pairs = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1])
             and unit[a][1] @ unit[b][1] >= least]
    links = {k: 0 for k in range(len(rows))}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, brute.groups(pairs, range(len(rows)))


def clusters(seed, n, width, centres, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, width))
    return [(base[i % centres] + noise * rng.normal(size=width)).tolist() for i in range(n)]


def compare(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.vec_id: r for r in ed.near_duplicates(frame, **options).collect()}
    links, root = truth(rows)
    assert len(found) == len(rows)
    want, got = sum(links.values()), sum(r.n_links for r in found.values())
    assert all(found[k].n_links <= links[k] for k in links)  # no link below the similarity
    return got / want if want else 1.0, sum(found[k].component_id == root[k] for k in root) / len(root), found


def test_recall_against_brute_force(spark):
    vectors = clusters(1, 500, 64, 40, 0.07) + clusters(2, 300, 64, 300, 0.1)
    recall, same, _ = compare(spark, [(i, v, i % 3) for i, v in enumerate(vectors)])
    assert recall == 1.0 and same == 1.0


def test_hot_list_in_slices_with_copies(spark):
    vectors = clusters(3, 200, 16, 1, 0.06)
    vectors += [vectors[0]] * 30 + clusters(4, 40, 16, 5, 0.1)
    recall, same, _ = compare(spark, [(i, v, 1) for i, v in enumerate(vectors)], slice_size=16)
    assert recall == 1.0 and same == 1.0


def test_no_link_is_lost_on_uneven_vectors(spark):
    """Few strong dimensions, and planted pairs on both sides of the bound: both ends count every link."""
    rng = np.random.default_rng(9)
    spread = 0.8 ** np.arange(64)
    x = rng.normal(size=(5000, 64)) * spread
    near = x[:800] / np.linalg.norm(x[:800], axis=1, keepdims=True)
    side = rng.normal(size=near.shape) * spread
    side -= (side * near).sum(1, keepdims=True) * near
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.978, 0.983, size=(800, 1))
    x = np.concatenate([x, cosine * near + np.sqrt(1 - cosine ** 2) * side]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    grid = unit @ unit.T
    np.fill_diagonal(grid, -1)
    want = (grid >= 0.98).sum(1)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4)
    found = {r.vec_id: r.n_links for r in ed.near_duplicates(frame).collect()}
    assert want.sum() > 900 and [found[i] for i in range(len(x))] == want.tolist()


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert compare(spark, rows)[:2] == (1.0, 1.0)


def test_edges(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(0, v, 1), (1, w, 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 1.0, 1.0], 1),
            (8, [], 1), (9, [1.0, 2.0], 1), (10, [1.0, 2.0], 1), (11, [float("inf"), 1.0, 1.0], 1), (12, [1e-30, 2e-30, 3e-30], 1)]
    recall, same, found = compare(spark, rows)
    assert recall == 1.0 and same == 1.0
    assert not found[1].kept and found[3].kept and not found[10].kept and not found[12].kept
    frame = spark.createDataFrame(rows + [(None, v, 1), (0, v, 1)], SCHEMA).withColumn("key", F.lit("clash")).withColumn("root", F.lit(1))
    again = ed.near_duplicates(frame).collect()
    assert len(again) == len(rows) + 2
    assert sorted(r.n_links for r in again if r.vec_id == 0) == [4, 4] and [r.kept for r in again if r.vec_id is None] == [False]
    assert ed.near_duplicates(frame.limit(0)).count() == 0
    assert [tuple(r) for r in ed.near_duplicates(frame.filter("vec_id = 5")).collect()] == [(5, 0, 5, True)]
