import random

import brute
import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citeloom.llm import ngram_join as nj
from citeloom.llm.components import connected


def check(spark, docs, **options):
    """docs: {id: text}"""
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link(frame, **options).collect()}
    assert found == brute.near_components(docs, options.get("words", 4), options.get("percent", 85))


def copies(seed, n, edits, size=60, base_words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(base_words)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_groups_of_near_copies(spark):
    texts = copies(1, 60, 3) + copies(2, 40, 2, size=30) + copies(3, 30, 6, size=120) + ["a b", "A B", "a b c", "", None, " "]
    check(spark, dict(enumerate(texts, 10)))


def test_salted_signatures_and_small_blocks(spark):
    texts = copies(4, 80, 4, base_words=12) + copies(5, 40, 3, size=25, base_words=6)
    check(spark, dict(enumerate(texts, 1)), hot_rows=5, block=8, sketch_bits=6)


def test_table_and_other_parameters(spark, small_docs):
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link(small_docs, words=5, percent=80).collect()}
    assert found == brute.near_components(docs, 5, 80)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(6, 80), st.integers(0, 3))
def test_linked_sets_share_a_signature(seed, size, level):
    """Whatever the classes of the tokens, and whatever is struck out of a set and added to it."""
    rng = np.random.default_rng(seed)
    counts = rng.choice([1, 2, 400, 4000][:level + 1], size=1 << nj.SKETCH_BITS).astype(np.uint64)
    signer = nj.Signer(counts)
    signer.classes = rng.choice([1, 2, 3], size=1 << nj.SKETCH_BITS, p=[[1, 0, 0], [.5, .5, 0], [.2, .5, .3], [0, .5, .5]][level]).astype(np.uint8)
    signer.single[:] = False
    base = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))
    gone = rng.integers(0, nj.allowed_missing(len(base), 85) + 1)
    added = np.unique(rng.integers(0, 2**63, size=rng.integers(0, size // 5 + 1), dtype=np.uint64))
    other = np.union1d(np.delete(base, rng.choice(len(base), size=gone, replace=False)), added)
    shared = len(np.intersect1d(base, other))
    if 100 * shared >= 85 * (len(base) + len(other) - shared) and not np.array_equal(base, other):
        assert len(np.intersect1d(signer.of(base)[0], signer.of(other)[0]))


def test_parity_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 40, 300, dtype=np.uint64)) for _ in range(2))
        b = np.union1d(a[:rng.integers(1, 300)], b[:rng.integers(1, 60)])
        assert nj.bits_apart(nj.parity(a), nj.parity(b)) <= len(np.setxor1d(a, b))
    wide, narrow = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5000, 40))
    assert len(nj.parity(wide)) > len(nj.parity(narrow)) and nj.bits_apart(nj.parity(wide), nj.parity(narrow)) <= len(np.setxor1d(wide, narrow))


def test_long_copies(spark):
    """Sets whose bitmaps have different widths, near the bound."""
    texts = copies(7, 14, 60, size=1030, base_words=900) + copies(8, 14, 12, size=258, base_words=300) + copies(9, 10, 200, size=4100, base_words=3000)
    texts += [" ".join(t.split()[:k]) for t, k in zip(texts[::5], (960, 1000, 1020, 240, 250, 4000, 3700, 4090))]
    check(spark, dict(enumerate(texts, 1)))
    check(spark, dict(enumerate(texts, 1)), block=3)


def test_edges_and_keeping_one(spark, edge_docs, no_docs):
    rows = nj.link(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[6].component_id == by_id[7].component_id == 6
    assert [by_id[i].n_shingles for i in (3, 4, 5, 6)] == [0, 0, 0, 1] and by_id[3].component_id == 3
    kept = nj.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == [0, 1, 3, 4, 5, 6, 8, 10]  # 9 repeats the text of 1; of the null ids the blank one stays
    assert nj.link(no_docs).count() == 0 and nj.keep_one(no_docs).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.groups(edges[:-1], {n for e in edges[:-1] for n in e})
    assert {frozenset(n for n in found if found[n] == r) for r in found.values()} == {frozenset(n for n in want if want[n] == r) for r in want.values()}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
