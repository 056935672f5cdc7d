import brute
import pytest
from pyspark.sql import functions as F

from citeloom.llm import mixing


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 500, None: 3}, {"a": 0, "b": 0}, {"a": 5}, {None: 7, "z": 1},
    {f"s{i:02d}": 7 ** (i % 5) for i in range(19)}, {"a": 0, "b": 50, "c": 1}, {"\U0001F600": 5, "￿": 90, "é": 4},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert found == pytest.approx(want)


def test_mix_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    sizes = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    for source, own in brute.by_group(rows, "source").items():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        rate = own[0].target / own[0].source_size
        assert all(int(rate) <= r.copies <= min(3, int(rate) + 1) for r in own)
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1
        assert sum(r.copies * r.size for r in own) == pytest.approx(own[0].target, abs=max(r.size for r in own))
    total = mixing.mixed_documents(docs)
    assert total.columns == docs.columns
    taken = {r.doc_id: r["count"] for r in total.groupBy("doc_id").count().collect()}
    assert taken == {r.doc_id: r.copies for r in rows if r.copies}


def test_edges(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r.size for r in rows) == sorted(len(brute.words(r.text)) for r in edge_docs.collect())
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_equal_rows_share_what_they_take(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 7 + [(2, "d", "y")] * 40 + [(3, "d e f g h i", "z")], "doc_id long, text string, source string")
    rows, mixed = mixing.mix(docs).collect(), mixing.mixed_documents(docs)
    want = {}
    for r in rows:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}
