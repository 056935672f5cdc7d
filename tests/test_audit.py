"""Claims, bibliographies, verdict replies, ordered operators, resume rules."""

import random

from pyspark.sql import functions as F

from citeloom.catalog.audit import length_judge
from citeloom.functions.text import strip_bibliography
from citeloom.operators import audit as A, conversation as V, ordered as O, resume as Q
from citeloom.catalog.fixtures import letter_embedder
from citeloom.operators.backfill import embed_texts

DOC = r"""# Head with [[9]](#src-9) is never a claim at all
| Tunnel depth 300 feet below | [[2]](#src-2) [\[2\]](#src-2) and [[1]](#src-1) |
|---|---|
Plain sentence without any mark here. The pump lifts 300 million gallons a day [[4]](#src-4) [[3]](#src-3). Too short [[1]](#src-1).
--- rule with [[1]](#src-1) is skipped whatever its length may be
## Sources
1. <a id="src-1"></a>One `sources/a/one.pdf`
2. <a id="src-2"></a>Two, no file
3. <a id="src-3"></a>Old `sources/a/old.pdf`
3. <a id="src-3"></a>New `sources/a/new.pdf`
"""


def docs(spark):
    return spark.createDataFrame([("d.md", DOC)], "doc string, text string")


def test_claims_by_hand(spark):
    rows = [(r["claim"], r["cites"], r["cited_files"]) for r in A.claims(docs(spark)).orderBy("i").collect()]
    assert [r[1] for r in rows] == [[2, 2, 1], [3, 4], [1]]
    assert rows[0][0].startswith("Tunnel depth 300 feet below  /")
    assert rows[0][2] == ["sources/a/one.pdf"] and rows[1][2] == ["sources/a/new.pdf"]
    assert rows[1][0] == "The pump lifts 300 million gallons a day ."


def test_claims_of_any_length_are_whole(spark):
    def claim(n):
        text = "x" * (n - 1) + ".[[1]](#src-1)"
        return A.claims(spark.createDataFrame([("d", text)], "doc string, text string")).first()["claim"]

    assert [len(claim(n)) for n in (2, 25, 5000)] == [2, 25, 5000]


def test_an_edit_late_in_a_claim_is_judged_again(spark):
    def claims(amount):
        text = "The long statement " + "goes on and on " * 10 + f"until it names {amount} million [[1]](#src-1)."
        return A.claims(spark.createDataFrame([("d", text)], "doc string, text string"))

    assert A.reverify_changed(claims(1400), claims(14)).count() == 1
    assert A.reverify_changed(claims(14), claims(14)).count() == 0


def test_last_bibliography_entry_wins(spark):
    rows = {r["n"]: r["file"] for r in A.parse_bibliography(docs(spark)).collect()}
    assert rows == {1: "sources/a/one.pdf", 2: None, 3: "sources/a/new.pdf"}
    assert "Sources" not in docs(spark).select(strip_bibliography(F.col("text"))).first()[0]


def test_verdict_replies(spark):
    replies = [("a", '<think>{"verdict":"X"}</think> {"verdict":"PARTIAL","confidence":0.7}'), ("b", "NOT_FOUND I think"),
               ("c", "nothing"), ("d", 'so: {"verdict":"SUPPORTED","confidence":1,"evidence":null} ok'), ("e", '{"confidence": 1}')]
    rows = {r["cid"]: (r["verdict"], r["confidence"]) for r in A.verdict_rows(spark.createDataFrame(replies, "cid string, reply string")).collect()}
    assert rows == {"a": ("PARTIAL", 0.7), "b": ("NOT_FOUND", 0.5), "c": ("ERROR", 0.0), "d": ("SUPPORTED", 1.0), "e": ("ERROR", 0.0)}


def test_judge_runs_once_per_claim(spark):
    p = [("f", 1, "alpha beta gamma")]
    work = spark.createDataFrame([("1", "alpha beta", p), ("2", "other words", p)],
                                 "cid string, claim string, passages array<struct<file string, p int, text string>>")
    first = A.batch_verdicts(work, work.filter("cid = '2'"), length_judge)
    assert [(r["cid"], r["verdict"]) for r in first.collect()] == [("1", "PARTIAL")]  # ten characters


def test_resume_rules_differ(spark):
    log = spark.createDataFrame([("a", "done"), ("b", "error"), ("b", "error")], "file string, status string")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert {r[0] for r in Q.pending(work, Q.done_set(log), "file").collect()} == {"b", "c"}
    assert {r[0] for r in Q.pending(work, Q.logged_set(log, "file"), "file").collect()} == {"c"}


def test_ordered_operators_equal_plain_windows_on_one_hot_key(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i}", i, rng.randint(1, 9), "v%d" % i if rng.random() < 0.1 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, n int, v string")
    got = O.running_sum_before(O.last_known(df, ["k"], ["o"], F.col("v"), "last", inclusive=False, width=16), ["k"], "o", F.col("n"), "sum", width=16)
    seen, total = {}, {}
    want = {}
    for k, o, n, v in rows:
        want[o] = (seen.get(k), total.get(k, 0))
        total[k] = total.get(k, 0) + n
        seen[k] = v if v is not None else seen.get(k)
    assert {r["o"]: (r["last"], r["sum"]) for r in got.collect()} == want


def test_history_filters_after_the_cut(spark):
    turns = [(1, i, "system" if i == 4 else "user", f"m{i}") for i in range(9)]
    rows = V.history(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).filter("turn = 8").first()
    assert [m["content"] for m in rows["history"]] == ["m2", "m3", "m5", "m6", "m7"]


def test_embedder_width_is_checked(spark):
    chunks = spark.createDataFrame([("a", "x y")], "id string, text string")
    assert len(embed_texts(chunks, letter_embedder("abcdefgh"), 8).first()["embedding"]) == 8
    try:
        embed_texts(chunks, letter_embedder("abcdefgh"), 9).collect()
        raise AssertionError("width was not checked")
    except Exception as exc:
        assert "9 wide" in str(exc)


def test_history_across_ranges(spark):
    """Narrow ranges, gaps and long conversations give what one window over each conversation gives."""
    rng = random.Random(4)
    turns = []
    for conv in range(6):
        numbers = sorted(rng.sample(range(60), rng.randint(1, 40)))
        turns += [(conv, n, rng.choice(["user", "assistant", "system", None]), rng.choice([f"t{n}", "", None])) for n in numbers]
    frame = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    want = {}
    for conv, n, _, _ in turns:
        before = [t for t in turns if t[0] == conv and t[1] < n][-6:]
        want[conv, n] = [(r, x) for _, _, r, x in before if r in ("user", "assistant") and x]
    for width in (1, 3, 7, 4096):
        found = {(r["conv_id"], r["turn"]): [tuple(h) for h in r["history"]] for r in V.history(frame, width=width).collect()}
        assert found == want


def test_squeezing_white_space_changes_nothing_else(spark):
    """Runs of any white space become one blank, single blanks stay; the pattern meets single blanks no more."""
    import re

    from citeloom.functions import text as T

    rows = [(a + b + c,) for a in ("x", "", "é") for b in [*T.WHITESPACE, "  ", " \t", "\t ", "\xa0  ", "~", "!"] for c in ("y", "", " ", "　z  z")]
    got = spark.createDataFrame(rows, "t string").select("t", T.squeeze_space(F.col("t")).alias("s")).collect()
    assert all(r["s"] == re.sub(f"[{re.escape(T.WHITESPACE)}]+", " ", r["t"]) for r in got)
    assert spark.createDataFrame([("a b c",)], "t string").filter(F.col("t").rlike(T._WS_RUN)).isEmpty()


def test_claims_are_made_once_for_both_sides(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["reverify_changed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_a_text_is_lowered_once_for_all_terms(spark):
    from citeloom.functions import text as T

    rows = [("Alpha & Beta gamma", ["zeta", "BETA", "alpha"]), ("none", ["x1"]), (None, ["x1"]), ("a", None), ("", [])]
    docs = spark.createDataFrame(rows, "t string, w array<string>")
    snippet = T.match_snippet(F.col("t"), F.col("w"))
    assert [r[0] for r in docs.select(snippet).collect()] == ["<mark>Alpha</mark> &amp; <mark>Beta</mark> gamma …", "none …", None, None, " …"]
    assert "instr(lower(t)" not in str(snippet)


def test_the_log_of_the_first_step_names_passages_and_the_second_reads_them(spark):
    """Texts are fetched once, to judge: the log has places. Rows of one id stay apart, claims that come twice are judged twice."""
    from citeloom.plans import claim_audit as CA

    embed = letter_embedder("ab")
    chunk_rows = [(1, "f1", 1, "a  a one"), (1, "f1", 1, "a  a one"), (1, "f0", 2, "a other"), (2, "f2", 1, "b b two"), (3, "f3", 4, "ab three")]
    chunks = spark.createDataFrame(chunk_rows, "id bigint, file string, page_start int, text string")
    vectors = embed_texts(chunks.dropDuplicates(["id"]), embed, 2).selectExpr("id", "embedding AS vector")
    text = "a a claim [[1]](#src-1).\nb b other [[1]](#src-1).\n"
    documents = spark.createDataFrame([("d", text), ("d", text), ("e", "ab third [[1]](#src-1).")], "doc string, text string")
    log = CA.retrieve_step(documents, spark.createDataFrame([], "cid string"), chunks, vectors, embed, 2).localCheckpoint()
    assert "text" not in log.schema["passages"].dataType.elementType.names
    assert all(r["passages"] for r in log.collect())
    prompts = CA.judge_prompts(log, chunks).collect()
    assert len(prompts) == log.count() == 5
    third = [r["prompt"] for r in prompts if "ab third" in r["prompt"]][0]
    found = third.split(A.FOUND)[1]
    assert found.count("f1, page 1: a a one") == 2 and found.count("f0, page 2: a other") == 1 and "f2, page 1: b b two" in found
    judged = CA.judge_step(log, spark.createDataFrame([], "cid string"), chunks, length_judge)
    assert {r["doc"] for r in judged.collect()} == {"d", "e"}
    assert CA.judge_step(log, judged, chunks, length_judge).isEmpty()


def test_places_of_evidence_have_no_texts(spark):
    """Candidates are ranked by their files; whole texts are joined to the ranked passages only."""
    chunks = spark.createDataFrame([(i, f"f{i % 3}", 1, f"word text {i}") for i in range(20)], "id bigint, file string, page_start int, text string")
    vectors = embed_texts(chunks, letter_embedder("wx"), 2).selectExpr("id", "embedding AS vector")
    asked = spark.createDataFrame([(1, "word", [1.0, 0.0], ["f2"])], "qid bigint, text string, vector array<float>, cited_files array<string>")
    places = A.evidence_places(asked, chunks, vectors)
    assert "text" not in places.columns
    rows = A.retrieve_evidence(asked, chunks, vectors).orderBy("rank0").collect()
    assert len(rows) == A.PASSAGES and [r["text"] for r in rows] == [f"word text {r['id']}" for r in rows]
    assert rows[0]["file"] == "f2" and [r["id"] for r in rows] == [r["id"] for r in places.orderBy("rank0").collect()]
