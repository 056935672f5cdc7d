import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from citeloom.llm import quality_rules as qr


def test_measures(spark, small_docs):
    extra = spark.createDataFrame([(10**6, "a b c d e f g h a b c d e f g h"), (10**6 + 1, "x " * 40), (10**6 + 2, "l1 a\n\nl1 a\n \nl2\nl1 a"), (10**6 + 3, None),
                                   (10**6 + 4, "a b c d e f g h i " * 300), (10**6 + 5, "é𝒳#|<> \x0b\x0c\x85 \xa0")], "doc_id long, text string")
    docs = small_docs.select("doc_id", "text").unionByName(extra).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = qr.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_lines) == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_buckets_hold_their_values(spark):
    values = spark.range(0, 3000).withColumn("v", F.col("id") * F.col("id"))
    rows = values.select("v", qr.bucket(F.col("v")).alias("b"), qr.bucket_top(qr.bucket(F.col("v"))).alias("top")).collect()
    for a, b in zip(rows, rows[1:]):
        assert a.v <= a.top and a.top <= a.v * 1.0625 and a.b <= b.b


def plain(n, doc, source, word="word"):
    return [(doc + i, " ".join(f"{word}{(i * 7 + j) % 500:03d}" for j in range(60)), "en", source) for i in range(n)]


def test_bounds_adapt_to_the_source(spark):
    """Marks that are usual in one source are kept there and rejected where they are rare."""
    rows = plain(300, 0, "prose") + plain(300, 1000, "code", "x=#&#") + plain(2, 2000, "tiny") + plain(2, 3000, "tiny2", "##$$%")
    rows += plain(3, 4000, "prose", "x=#&#")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.judge(docs).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300)) and not any(kept[4000 + i] for i in range(3))
    assert all(kept[2000 + i] for i in range(2))


def test_sketches_merge(spark):
    docs = spark.createDataFrame(plain(40, 0, "a") + plain(50, 100, "b", "longerword"), "doc_id long, text string, lang string, source string")
    measured = qr.judge(docs)
    whole = qr.sketch(measured, ["lang"])
    parts = qr.sketch(measured, ["lang", "source"]).groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_edges(edge_docs, no_docs):
    rows = qr.judge(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)
    kept = qr.kept_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in rows if r.kept)
    assert qr.judge(no_docs).count() == 0 and qr.kept_documents(no_docs).count() == 0


@pytest.mark.parametrize("share", [0.12, 0.2, 0.3])
def test_junk_does_not_loosen_its_source(spark, share):
    """Junk in 12 to 30 % of a source is rejected by the query's rules and the pipeline's stage; what most of a source shows
    stays usual."""
    n = round(300 * share)
    clean = plain(300 - n, 0, "dirty") + plain(300, 1000, "code", "x=#&#")
    junk = [(3000 + i, " | ".join(t.split()), lang, s) for i, t, lang, s in plain(n, 0, "dirty")]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs.withColumn("n_chars", F.length("text")), "").collect()}
    assert kept == {r[0] for r in clean} == {r.doc_id for r in qr.judge(docs).collect() if r.kept}


def test_no_count_of_documents_turns_a_verdict(spark):
    """The same documents three times over, under new ids, are judged as before; so are small sources beside large ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once = {r.doc_id: r.kept for r in qr.judge(docs).collect()}
    thrice = docs.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("doc_id", F.col("doc_id") * 3 + F.col("k"))
    assert {r.doc_id: r.kept for r in qr.judge(thrice).collect()} == {3 * i + k: v for i, v in once.items() for k in range(3)}
    assert 0.5 < sum(once.values()) / len(once) < 1


def test_small_groups_borrow_bounds(spark):
    """Sources too small for bounds of their own take those of their language, and languages too small those of all."""
    rows = plain(300, 0, "prose") + plain(5, 2000, "odd", "x=#&#")
    rows += [(3000 + i, t, "xx", s) for i, (_, t, _, s) in enumerate(plain(5, 0, "odd", "x=#&#") + plain(5, 0, "other"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.judge(docs).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[2000 + i] for i in range(5))
    assert not any(kept[3000 + i] for i in range(5)) and all(kept[3005 + i] for i in range(5))
    assert all(r.kept for r in qr.judge(docs, min_docs=1).collect())
