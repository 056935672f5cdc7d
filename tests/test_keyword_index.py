"""The keyword index: exact top-k by bounds, and upkeep by batches."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import impact_blocks as I, retrieval as R
from citeloom.plans import keyword_index as K


def corpus(n, seed=5):
    """Texts of very different lengths; rare words, and one word in every text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(["every"] + rng.choices(words, weights=[400 / (j + 1) for j in range(400)], k=rng.choice([3, 8, 20, 60, 200])))) for i in range(n)]


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"id {kind}, text string")


def questions(spark, n=12, seed=6):
    rng = random.Random(seed)
    asked = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 6))) + (" every" if i % 3 == 0 else "")) for i in range(n)]
    return spark.createDataFrame(asked + [(90, "zzz"), (91, ""), (92, "every every w1")], "qid bigint, text string")


def hits(rows):
    return {(r["qid"], r["rank0"]): (r["id"], round(r["score"], 7)) for r in rows.collect()}


@pytest.mark.parametrize("range_rows, first", [(512, 2), (7, 1), (20, 3)])
def test_bounds_leave_nothing_out(spark, tmp_path, range_rows, first):
    docs = frame(spark, corpus(300))
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, docs, 0)
    K.refresh(spark, index, range_rows)
    for k in (1, 5, 40):
        assert hits(K.topk(index, questions(spark), k, 2, first)) == hits(R.bm25_topk(questions(spark), docs, k, 2))


def test_blocks_below_the_kth_score_are_not_read(spark, tmp_path):
    """Short texts with the rare word win; ranges of long texts are never scored."""
    rows = [(i, "every " + "w1 " * (i % 3 == 0) + "pad " * (3 if i < 200 else 400)) for i in range(2000)]
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, frame(spark, rows), 0)
    K.refresh(spark, index, 20)
    seen = []
    question = spark.createDataFrame([(1, "w1")], "qid bigint, text string")
    found = hits(K.topk(index, question, 5, 2, seen=lambda pairs: seen.append(pairs.count())))
    assert found == hits(R.bm25_topk(question, frame(spark, rows), 5, 2))
    blocks = K.blocks(spark, index, K.refresh(spark, index))
    assert seen[0] <= 12 and blocks.filter("term = 'w1'").count() > 90
    assert blocks.agg(F.max(F.size("rows"))).first()[0] <= 60


def test_upkeep_answers_like_a_fresh_build(spark, tmp_path):
    rows = corpus(80)
    docs = frame(spark, rows)
    index = K.KeywordIndex(str(tmp_path / "kept"))
    assert K.topk(index, questions(spark), 5, 2).count() == 0
    K.add(index, frame(spark, [(i, "w1 w2 w3 stale") for i, _ in rows[:30]] + [(500 + i, "w1 w5") for i in range(9)]), 0)
    K.add(index, frame(spark, rows[30:]), 1)
    K.add(index, frame(spark, rows[30:]), 1)  # repeated
    assert K.dictionary(spark, index).filter("term = 'stale'").first()["df"] == 30
    K.add(index, frame(spark, rows[:30]), 2)  # changed
    K.remove(index, frame(spark, [(500 + i, "") for i in range(9)]), 3)
    want = hits(R.bm25_topk(questions(spark), docs, 8, 2))
    assert hits(K.topk(index, questions(spark), 8, 2)) == want
    before = K.refresh(spark, index)
    assert K.refresh(spark, index) == before  # nothing changed, nothing made
    K.merge(spark, index)
    assert len(K.committed(spark, index)) == 1 and hits(K.topk(index, questions(spark), 8, 2)) == want
    K.add(index, frame(spark, rows[:30]), 2)  # a batch that came before the merge is not taken twice
    assert hits(K.topk(index, questions(spark), 8, 2)) == want
    K.add(index, frame(spark, [(0, "w1 again")]), 4)
    changed = frame(spark, [(0, "w1 again")] + rows[1:])
    assert hits(K.topk(index, questions(spark), 8, 2)) == hits(R.bm25_topk(questions(spark), changed, 8, 2))


def test_a_batch_that_was_not_committed_is_not_seen(spark, tmp_path):
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, frame(spark, [(1, "river lock")]), 0)
    frame(spark, [(2, "river river")]).select("id", K.word_counts(F.col("text")).alias("words"), F.lit(False).alias("gone")) \
        .write.parquet(index.segment("b00000001-failed"))
    assert {r["id"] for r in K.topk(index, spark.createDataFrame([(1, "river")], "qid int, text string"), 5).collect()} == {1}


def test_odd_documents_and_text_ids(spark, tmp_path):
    rows = [("a", None), ("b", ""), ("c", "!!"), ("d", "Écluse ecluse gate"), ("e", "gate " * 3000), ("f", "gate gate")]
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, frame(spark, rows[:3], "string"), 0)
    assert K.topk(index, spark.createDataFrame([(1, "gate")], "qid int, text string"), 5).count() == 0
    K.add(index, frame(spark, rows[3:], "string"), 1)
    asked = spark.createDataFrame([(1, "gate ecluse"), (2, "gate")], "qid int, text string")
    assert hits(K.topk(index, asked, 5)) == hits(R.bm25_topk(asked, frame(spark, [(i, t or "") for i, t in rows], "string"), 5))


def test_word_counts_are_those_of_postings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    counted = docs.select("id", F.explode(K.word_counts(F.col("text"))).alias("w")).select("id", "w.term", "w.tf")
    assert counted.exceptAll(R.postings(docs).select("id", "term", "tf")).isEmpty() and counted.count() == R.postings(docs).count()


def test_ranges_hold_like_lengths_and_are_bounded(spark):
    lengths = spark.range(5000).select("id", (F.pow(F.col("id") % 60, F.lit(2)) + 1).cast("int").alias("dl"))
    ranges = I.Ranges.of(lengths, 100)
    rows = lengths.withColumn("range", ranges.place(F.col("id"), F.col("dl"))).groupBy("range").agg(
        F.count(F.lit(1)).alias("n"), F.min("dl").alias("low"), F.max("dl").alias("high")).collect()
    assert {r["range"] for r in rows} <= set(range(ranges.total)) and max(r["n"] for r in rows) <= 160
    assert all(r["high"] + 1 <= 1.2 * (r["low"] + 1) for r in rows)


def test_documents_travel_once_and_no_posting_by_itself(spark, tmp_path):
    """Building blocks shuffles a row per document; blocks hold what the postings say, in the order of their words."""
    docs = frame(spark, corpus(60)).withColumn("words", K.word_counts(F.col("text"))).withColumn("dl", F.aggregate("words", F.lit(0), lambda n, w: n + w["tf"]))
    ranges = I.Ranges.of(docs, 10)
    placed = docs.select("id", ranges.place(F.col("id"), F.col("dl")).alias("range"), I.length_norm(F.col("dl"), 30.0).alias("norm"), "words")
    I.write_blocks(placed, ranges, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).select("range", "term", "n", "cf", "top", F.explode("rows").alias("r")).select("range", "term", "n", "cf", "top", "r.*")
    posts = docs.select("id", "dl", ranges.place(F.col("id"), F.col("dl")).alias("range"), F.explode("words").alias("w")).select(
        "id", "range", "w.term", "w.tf", I.impact(F.col("w.tf"), F.col("dl"), 30.0).alias("impact"))
    sums = posts.groupBy("range", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").cast("bigint").alias("cf"), F.max("impact").alias("top"))
    want = posts.join(sums, ["range", "term"]).select("range", "term", "n", "cf", "top", "id", "impact")
    near = lambda rows: sorted((r["range"], r["term"], r["n"], r["cf"], round(r["top"], 12), r["id"], round(r["impact"], 12)) for r in rows.collect())
    assert near(got) == near(want)


def test_sections_of_one_id_add_up(spark, tmp_path):
    """Rows that share an id count as one hit with the sum of their weights; fields weigh by their own statistics."""
    from citeloom.operators import sections as N
    from citeloom.plans import section_index as SI

    rows = [(f"s{i}", f"head w{i % 7}", "doc title", f"w{i % 5} w{i % 3} body " * (1 + i % 4)) for i in range(40)] + [("s1", None, "doc w1", "w1 " * 30)]
    records = spark.createDataFrame(rows, "id string, section string, doc string, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "titl"), (3, "head body w6")], "qid bigint, text string")
    SI.build(SI.SectionIndex(str(tmp_path)), records)
    assert hits(SI.search(SI.SectionIndex(str(tmp_path)), asked)) == hits(N.section_search(asked, records.fillna("")))


@pytest.mark.parametrize("postings, asked_rows", [(2000, 50), (1 << 22, 1000)])
def test_many_questions_meet_slices_in_cells(spark, tmp_path, monkeypatch, postings, asked_rows):
    """No (question, range) pair is written down; lists are those of the plain search, ties and repeated words too."""
    docs, asked = frame(spark, corpus(400) + [(1000 + i, f"w{i % 9} every") for i in range(60)]), questions(spark, 150)
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, docs, 0)
    K.refresh(spark, index, 20)
    written, cells = [], I.cell_topk
    keep = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name: written.append(name) or keep(df, name))
    monkeypatch.setattr(I, "cell_topk", lambda *a: cells(*a, postings, asked_rows))
    monkeypatch.setattr(I, "BLOCK_ROWS", 40)
    monkeypatch.setattr(I, "MOST_BOUNDS", 100)
    got = K.topk(index, asked, 30, 2)
    assert "bounds" not in written and "asked-words" in written
    assert hits(got) == hits(R.bm25_topk(asked, docs, 30, 2))


def test_cells_are_answered_in_rounds(spark, tmp_path, monkeypatch):
    """More cells than may be moved at once follow when those before are done; lists stay those of the plain search."""
    docs, asked = frame(spark, corpus(400) + [(1000 + i, f"w{i % 9} every") for i in range(60)]), questions(spark, 150)
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, docs, 0)
    K.refresh(spark, index, 20)
    rounds, cells, cut = [], I.cell_topk, I.pack_hits
    monkeypatch.setattr(I, "pack_hits", lambda packed, k: rounds.append(k) or cut(packed, k))
    monkeypatch.setattr(I, "cell_topk", lambda *a: cells(*a, 300, 20, most_moved=1))
    monkeypatch.setattr(I, "MOST_BOUNDS", 100)
    got = K.topk(index, asked, 30, 2)
    assert len(rounds) > 2
    assert hits(got) == hits(R.bm25_topk(asked, docs, 30, 2))


def test_a_cell_of_odd_rows():
    """An id twice in a range is one document, in two ranges two; absent words, text ids and a question without hits."""
    import pyarrow as pa

    post = pa.list_(pa.struct([("id", pa.string()), ("impact", pa.float64())]))
    rows = [[{"id": "b", "impact": 1.0}, {"id": "a", "impact": 1.0}, {"id": "a", "impact": 1.0}], [{"id": "a", "impact": 0.5}], [{"id": "c", "impact": 2.0}]]
    right = pa.table({"range": pa.array([0, 1, 0], pa.int32()), "code": pa.array([7, 7, 9]), "rows": pa.array(rows, post)})
    word = pa.list_(pa.struct([("less", pa.float64()), ("code", pa.int64())]))
    left = pa.table({"qid": pa.array([1, 2, 3]), "words": pa.array([[{"less": -2.0, "code": 7}], [{"less": -1.0, "code": 8}],
                                                                   [{"less": -1.0, "code": 7}, {"less": -0.25, "code": 9}]], word)})
    schema = pa.schema([("qid", pa.int64()), ("hits", pa.list_(pa.struct([("id", pa.string()), ("score", pa.float64())])))])
    got = {r["qid"]: [(h["id"], h["score"]) for h in r["hits"]] for r in I.cell_kernel(3, schema)(left, right).to_pylist()}
    assert got == {1: [("a", 2.0), ("b", 2.0), ("a", 1.0)], 3: [("a", 1.0), ("b", 1.0), ("a", 0.5)]}


def test_words_in_a_string_make_the_blocks_of_counted_words(spark, tmp_path):
    """Words come as often as they occur; counting them is left to the task that makes the blocks."""
    docs = frame(spark, corpus(60) + [(900, "a a b a"), (901, "")]).withColumn("dl", F.size(F.split("text", " ")))
    ranges = I.Ranges.of(docs, 10)
    placed = docs.select("id", ranges.place(F.col("id"), F.col("dl")).alias("range"), I.length_norm(F.col("dl"), 30.0).alias("norm"),
                         F.col("text").alias("words"), K.word_counts(F.col("text")).alias("counted"))
    for summed in (False, True):
        I.write_blocks(placed.drop("counted"), ranges, f"{tmp_path}/string{summed}", summed)
        I.write_blocks(placed.drop("words").withColumnRenamed("counted", "words"), ranges, f"{tmp_path}/counted{summed}", summed)
        rows = [sorted(map(str, spark.read.parquet(f"{tmp_path}/{kind}{summed}").collect())) for kind in ("string", "counted")]
        assert rows[0] == rows[1] and len(rows[0]) > 100


def test_segments_hold_words_uncounted_and_older_ones_are_read(spark, tmp_path):
    rows = corpus(40) + [(900, "Élan élan vital"), (901, None)]
    new, old = K.KeywordIndex(str(tmp_path / "new")), K.KeywordIndex(str(tmp_path / "old"))
    K.add(new, frame(spark, rows), 0)
    segment = spark.read.parquet(new.segment(K.committed(spark, new)[0][1]))
    assert [segment.schema[c].dataType.simpleString() for c in ("words", "dl")] == ["string", "int"]
    assert segment.filter("id = 900").select("words", "dl").first() == ("elan elan vital", 3)
    counted = frame(spark, rows[:20]).select("id", K.word_counts(F.coalesce("text", F.lit(""))).alias("words"), F.lit(False).alias("gone"))
    K._write_segment(counted, old, 0, False)
    K.add(old, frame(spark, rows[20:]), 1)
    assert hits(K.topk(old, questions(spark), 8, 2)) == hits(K.topk(new, questions(spark), 8, 2))
    K.merge(spark, old)
    assert hits(K.topk(old, questions(spark), 8, 2)) == hits(K.topk(new, questions(spark), 8, 2))


def test_ranges_are_bounded_in_words_too(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE_WORDS", 10_000)
    lengths = spark.range(400).select("id", F.when(F.col("id") < 300, 5).otherwise(1000).alias("dl"))
    ranges = I.Ranges.of(lengths, 1000)
    assert sorted(c for c in ranges.counts if c) == [1, 10]


@pytest.mark.parametrize("n, bounded", [(8, True), (40, False)])
def test_a_batch_of_questions_reads_the_blocks_once(spark, tmp_path, monkeypatch, n, bounded):
    """Forty questions leave hardly a range unread: no bounds are written for them; a few questions are bounded still."""
    docs, asked = frame(spark, corpus(300)), questions(spark, n)
    index = K.KeywordIndex(str(tmp_path))
    K.add(index, docs, 0)
    K.refresh(spark, index, 20)
    written, keep = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name: written.append(name) or keep(df, name))
    monkeypatch.setattr(I, "MOST_BOUNDS", 100)
    assert hits(K.topk(index, asked, 30, 2)) == hits(R.bm25_topk(asked, docs, 30, 2))
    assert ("bounds" in written) == bounded


def test_texts_of_hits_are_not_shuffled(spark):
    """Few hits meet the documents where these are read."""
    import __spark_entry__ as entry

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["hybrid_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
