"""Passages: hand cases, an independent cutter, coverage, page stream."""

import random

from pyspark.sql import functions as F

from citeloom.operators import chunking as C


def reference_cut(pages):
    """The rule restated over the whole joined text, without a moving window."""
    stream, starts = "", []
    for number, text in pages:
        starts.append((len(stream), number))
        stream += text + "\n\n"
    page = lambda x: [p for o, p in starts if o <= x][-1]
    out, i = [], 0
    while i < len(stream):
        j = min(i + 2800, len(stream))
        if j < len(stream):
            best = max(stream.rfind("\n\n", i + 1400, j), stream.rfind(". ", i + 1400, j))
            j = best + 1 if best >= 0 else j
        text = stream[i:j].strip()
        if len(text) > 80:
            out.append((len(out), page(i), page(max(i, j - 1)), text, i, j))
        if j >= len(stream):
            break
        i = j - 400
    return out


def cut(spark, text):
    df = C.chunk_documents(spark.createDataFrame([("f", text)], "file string, text string"))
    return [tuple(r) for r in df.orderBy("n").select("n", "page_start", "page_end", "text", "start_at", "end_at").collect()]


def test_short_texts_are_passages_too(spark):
    assert [r[3] for r in cut(spark, "x")] == ["x"]
    assert cut(spark, " \n ") == []


def test_breaks_at_the_later_mark(spark):
    text = "a" * 1500 + ". " + "b" * 500 + ". " + "c" * 3000
    first = cut(spark, text)[0]
    assert first[3] == ("a" * 1500 + ". " + "b" * 500 + ".")


def test_no_mark_in_second_half(spark):
    assert cut(spark, "ab. " + "x" * 5000)[0][5] == 2800


def test_pages_of_a_passage(spark):
    rows = cut(spark, "\n".join(["first " * 20, "", "third " * 20, "fourth " * 20]))
    assert [(r[1], r[2]) for r in rows] == [(1, 4)]


def test_random_texts_match_the_restated_rule(spark):
    rng = random.Random(5)
    docs = []
    for n in range(25):
        lines = ["".join(rng.choice(["word ", "end. ", "é", "long" * 40, ". ", "\t "]) for _ in range(rng.randint(0, 400)))
                 for _ in range(rng.randint(1, 60))]
        docs.append((f"f{n}", "\n".join(lines)))
    df = spark.createDataFrame(docs, "file string, text string")
    pages = df.select("file", F.posexplode(F.split("text", "\n")).alias("p", "text")).withColumn("page", F.col("p") + 1).drop("p")
    whole = {}
    for how in (C.chunk_documents(df), C.chunk_pages(pages)):
        got = {}
        for r in how.orderBy("file", "n").collect():
            got.setdefault(r["file"], []).append((r["n"], r["page_start"], r["page_end"], r["text"], r["start_at"], r["end_at"]))
        whole[len(whole)] = got
    import re

    for file, text in docs:
        kept = [(i, re.sub("[ \t]+", " ", x).strip()) for i, x in enumerate(text.split("\n"), 1)]
        want = reference_cut([(i, x) for i, x in kept if x])
        assert whole[0].get(file, []) == want
        assert whole[1].get(file, []) == want


def test_a_long_page_stays_linear_and_whole(spark):
    text = "sentence number one. " * 100_000
    rows = cut(spark, text)
    assert rows[0][4] == 0 and all(b[4] == a[5] - 400 for a, b in zip(rows, rows[1:]))
    assert rows[-1][5] == len(text.strip()) + 2


def test_first_corpus_wins(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "file string, v int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "file string, v int")
    assert sorted(r["v"] for r in C.union_corpora(a, b).collect()) == [1, 2, 4]


def odd_files(rng):
    """Texts without any mark, of blanks inside pages, of runs of line ends, with wide characters, and of tiny pages."""
    yield "plain", ["".join(rng.choice(["word ", "end. ", "é", "\U0001f600. ", ". "]) for _ in range(900)) for _ in range(30)]
    yield "no marks", ["x" * 90_000]
    yield "blank inside", ["a" * 3000 + "\n" * 9000 + "b. " * 2000, "\x0b" * 9000, "c"]
    yield "tiny pages", ["z"] * 9000
    yield "line ends", ["p\n\n\nq. \n\n" * 4000]
    yield "exactly one", ["y" * 2798]
    yield "one more", ["y" * 2799]
    yield "near a border", ["w" * (8192 - 2), "v" * 2500]


def test_many_tasks_cut_a_file_as_one_does(spark):
    files = list(odd_files(random.Random(8)))
    pages = spark.createDataFrame([(f, i, t) for f, ts in files for i, t in enumerate(ts, 1)], "file string, page int, text string")
    one = C.chunk_pages(pages, long=10**9)
    columns = ["file", "n", "id", "page_start", "page_end", "text", "start_at", "end_at"]
    want = sorted(map(tuple, one.select(columns).collect()))
    assert sorted(map(tuple, C._with_ids(C.cut_in_parallel(pages, width=8192)).select(columns).collect())) == want
    assert sorted(map(tuple, C.chunk_pages(pages, long=30_000).select(columns).collect())) == want


def test_long_documents_and_groups_of_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "_GROUP", 3)
    rng = random.Random(9)
    docs = spark.createDataFrame([(f"d{i}", "\n".join("".join(rng.choices(["word ", "end. ", "é "], k=60)) for _ in range(n)))
                                  for i, n in enumerate((3, 400, 1500))], "file string, text string")
    columns = ["file", "n", "page_start", "page_end", "text", "start_at", "end_at"]
    pages = docs.select("file", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    want = sorted(map(tuple, C.chunk_documents(docs).select(columns).collect()))
    assert sorted(map(tuple, C.cut_in_parallel(pages, width=8192 * 2).select(columns).collect())) == want
    assert sorted(map(tuple, C.chunk_documents(docs, long=5000).select(columns).collect())) == want


def test_segments_of_one_file_are_many_tasks(spark):
    narrow = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in narrow}
    try:
        for k, v in narrow.items():
            spark.conf.set(k, v)
        pages = spark.range(60).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("page"),
                                       F.concat_ws(". ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.hash(i, "id").cast("string"))).alias("text"))
        tasks = C.cut_in_parallel(pages, width=8192 * 4).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_table_function_in_small_batches(spark):
    from citeloom.functions import udfs

    pages = spark.createDataFrame([(f, i, t) for f, ts in list(odd_files(random.Random(3)))[:3] for i, t in enumerate(ts, 1)] + [("none", 1, None)],
                                  "file string, page int, text string")
    udfs.register(spark)
    pages.createOrReplaceTempView("odd_pages")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = spark.sql("SELECT * FROM chunk_text(TABLE(odd_pages) PARTITION BY file ORDER BY page)").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, C.chunk_pages(pages).select("file", "n", "page_start", "page_end", "text").collect()))


def test_tasks_grow_with_the_pages(spark, monkeypatch):
    """What one task sorts is bounded, however many pages there are."""
    monkeypatch.setattr(C, "TASK_CHARS", 2000)
    pages = spark.createDataFrame([(f"f{i % 40}", i // 40 + 1, "word " * 20) for i in range(400)], "file string, page int, text string")
    assert C.chunk_pages(pages).rdd.getNumPartitions() >= 20
