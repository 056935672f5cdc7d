import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import pytest

from citeloom.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run=2):
    w = WORD.findall((text or "").translate(brute.LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets=10_000, least=20, percent=25, run=2):
    """docs: list of (doc_id, text); rows of (doc_id, n_words, n_features, weight, score, rank)"""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = (Counter(place(f) for t in texts for f in features(t, run)[1]) for texts in ([t for _, t in docs], target))
    all_raw, all_aim = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (all_raw + buckets) / ((raw[b] + 1) * (all_aim + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, own = features(text, run)
        weight = sum(gain[place(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = [r + (k,) for k, r in enumerate(able[:len(able) * percent // 100], 1)]
    return sorted(drawn + [r + (None,) for r in able[len(drawn):]] + [r + (None,) for r in rows if r[1] < least], key=str)


def check(docs, target, **options):
    rows = I.resample(docs, target, **options).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()],
                 **{{"least_words": "least"}.get(k, k): v for k, v in options.items()})
    assert sorted(map(tuple, rows), key=str) == want
    return want


def test_table(spark, small_docs):
    want = check(small_docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert sum(r[5] is not None for r in want) > 20


@pytest.mark.parametrize("run", [1, 3])
def test_other_runs(spark, small_docs, run):
    check(small_docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), run=run, buckets=97, percent=60)


def test_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("one two three one two",), (None,), ("",)], "text string")
    check(edge_docs, target, percent=100, least_words=0)
    check(edge_docs, target)
    check(edge_docs, target.limit(0))
    assert I.resample(no_docs, target).collect() == []


def test_odd_texts(spark):
    odd = ["", "...", "a", "A a", "ÀB İ 日本語 　x", "a\x00b\nc", "x9 9x -- x9", "é́É", "\U0001f600 \U0001f600 z", "word " * 20_000, "t" * 100_000, "A_b[c]{d}@e`f~g\x7fh"]
    check(spark.createDataFrame(list(enumerate(odd * 3)), "doc_id long, text string"), spark.createDataFrame([(t,) for t in odd], "text string"), percent=50, least_words=1)


def test_ties_and_repeats(spark):
    """Copies with one id share a score; their ranks follow one another, and a cut inside them takes as many as fit."""
    text = "alpha beta gamma " * 8
    docs = spark.createDataFrame([(5, text)] * 37 + [(None, text)] * 5 + [(k, text + " delta") for k in range(6, 20)], "doc_id long, text string")
    check(docs, spark.createDataFrame([("alpha beta",)], "text string"), percent=40)
