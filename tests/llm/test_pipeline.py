import brute
import corpus_pipeline as cp
import pytest
from citeloom.llm import quality_rules, secret_scans
from test_packing import check


def near(texts, k, percent):
    return {i: c for i, (_, c) in brute.near_components(texts, k, percent).items()}


@pytest.fixture(scope="module")
def stages(spark, small_docs):
    """What every stage gives, each on all that the one before kept."""
    out, docs = [], small_docs
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, ""), "test-stage")
        out.append(docs)
    return out


def test_stages_against_brute_force(small_docs, stages):
    before = {r.doc_id: r for r in small_docs.collect()}
    kept = {r.doc_id: r for r in stages[0].collect()}
    judged = {r.doc_id: r.kept for r in quality_rules.judge(small_docs).collect()}
    assert kept == {i: r for i, r in before.items() if judged[i]}
    assert all(not brute.quality(r.text)[5] for r in kept.values())

    root = near({i: r.text for i, r in kept.items()}, 5, 80)
    single = {r.doc_id: r for r in stages[1].collect()}
    assert single == {i: r for i, r in kept.items() if root[i] == i}

    clean = {r.doc_id: r for r in stages[2].collect()}
    assert clean.keys() == single.keys()
    for i, r in single.items():
        spans = brute.base_spans(r.text) + brute.entropy_spans(r.text, secret_scans.CLASSES, secret_scans.ALLOWED, secret_scans.WINDOW)
        text = brute.redacted(r.text, spans) if spans else r.text
        assert (clean[i].text, clean[i].n_chars, clean[i].lang, clean[i].source) == (text, len(text), r.lang, r.source)

    sizes = {}
    for r in clean.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    wanted = brute.targets(sizes)
    mixed = stages[3].collect()
    counts = {}
    for r in mixed:
        assert r == clean[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    for i, r in clean.items():
        rate = wanted[r.source] / sizes[r.source]
        assert int(rate) <= counts.get(i, 0) <= int(rate) + 1
    check(stages[4].collect(), [(r.doc_id, r.text) for r in mixed])
    assert all(tuple(s.columns) == cp.COLUMNS for s in stages[:4])


def test_run_and_edges(spark, stages, edge_docs, no_docs):
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, rows.drop("sequence_id", "offset").collect())) == sorted(map(str, stages[4].drop("sequence_id", "offset").collect()))
    for docs in (edge_docs, no_docs):
        for _, stage in cp.STAGES:
            docs = cp.materialize(stage(spark, docs, ""), "test-edge")
    assert docs.count() == 0
