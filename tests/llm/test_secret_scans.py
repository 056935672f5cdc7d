import random

import brute
import pytest
from pyspark.sql import functions as F

from citeloom.llm import secret_scans as ss

TEXTS = [
    "", None, "nothing here", "password=abc", "password=token:abcdefgh", "PassWord : 'hunter22' x", "api_key=\"abcdef\" apikey==abcdef",
    "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" end", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "AKIA" + "A" * 15, "é𝒳 " + "ab12" * 6 + " é",
    "deadbeef" * 3 + "," + "0" * 23, "secret:secret:secretx", "kT9f3Lq8ZpW2xV7bN4cR6mYs1 and kT9f3Lq8ZpW2xV7bN4cR6mYs1", "EXAMPLEkT9f3Lq8ZpW2xV7bN4cR6mYs1",
    "0123456789ABCDEF0123456789ABCDEF", "12345678901234567890123456789", "550e8400-e29b-41d4-a716-446655440000", "donaudampfschifffahrtsgesellschaft",
    "password=kT9f3Lq8ZpW2xV7bN4cR6mYs1", "a" * 40 + "kT9f3Lq8ZpW2xV7bN4cR6mYs1" + "b" * 40, "x/" * 3000, "\n".join(["token=abcdef"] * 50),
]


def random_text(seed):
    rng = random.Random(seed)
    bits = ["password", "token", "=", ":", " ", "'", '"', "AKIA", "abc123", "ABCDEF", "9f", "é", "\n", "secret", "api_key", "0" * 10, "deadbeef"]
    return "".join(rng.choice(bits) for _ in range(60))


@pytest.fixture(scope="module")
def texts():
    return TEXTS + [random_text(i) for i in range(300)]


def test_spans_and_redaction(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = {r.doc_id: [(s.start, s.rank, s.end) for s in r.secrets] for r in ss.scan(frame).collect()}
    cut = {r.doc_id: r.text for r in ss.redact(frame).collect()}
    for i, text in enumerate(texts):
        want = sorted(brute.base_spans(text) + brute.entropy_spans(text, ss.CLASSES, ss.ALLOWED, ss.WINDOW))
        assert spans[i] == want, text
        assert cut[i] == (text if text is None or not want else brute.redacted(text, want)), text


def test_entropy_finds_a_key_among_letters(spark):
    rows = ss.scan(spark.createDataFrame([(1, TEXTS[14])], "doc_id long, text string")).first().secrets
    assert [(s.start, s.end) for s in rows if s.rank == 3] == [(0, 25), (30, 55)]


def test_edges(edge_docs, no_docs):
    found = ss.scan(edge_docs)
    assert sorted(found.columns) == sorted(edge_docs.columns)
    assert found.filter(F.size("secrets") > 0).count() == 0 and found.count() == edge_docs.count()
    assert ss.redact(edge_docs).exceptAll(edge_docs).count() == 0
    assert ss.scan(no_docs).count() == 0 and ss.redact(no_docs).count() == 0
