import itertools
import random
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeloom.llm import token_counts as tc
from citeloom.llm.common import TextCache

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.counter(PATH)

ODD = [
    "", " ", "don't we're I'LL '", "hello<|endoftext|>x", "!!<|endoftext|>!! <|startoftext|>'s", "Éáb ﬁ İstanbul", "日本語 한국어 한",
    "a1b22c  ...---===''''", "\x1c\x85\xa0x y", "\U0001D4B3 \U0001F469‍\U0001F469 ok", "'" * 9 + "re", "ΑΣ ὈΔ", "éé́xyz'tx", "ẞ ß <|endof",
    "½ ² ३", "x" * 300, "=" * 70 + "-" * 5,
]


def want(text):
    return [len(LIBRARY.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def got(text):
    return np.cumsum(np.frombuffer(COUNTER.deltas_of(text), "<i2")).tolist()


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_of_odd_texts(text):
    assert got(text) == want(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeghinorst'.,!<|>é́Ññ \n12日"), max_size=24))
def test_every_prefix_of_any_text(text):
    assert got(text) == want(text)


BLANKS = "\xa0\u3000\x0c\x0b\x85\u2003\u2028\u1680"


@pytest.mark.parametrize("blank", BLANKS)
def test_long_runs_of_other_white_space(blank):
    for text in (blank * 4, "a" + blank * 4 + "b", "don" + blank * 5 + "'t", "!" + blank * 40 + "!", "é" + blank * 4 + "İx",
                 blank * 4 + "<|endoftext|>" + blank * 4, blank * 2 + BLANKS + "日" + BLANKS):
        assert got(text) == want(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "it's", "!", "é", "1", " ", "\n", "<|endoftext|>", BLANKS, *(b * 4 for b in BLANKS), *BLANKS]), max_size=12))
def test_every_prefix_with_other_white_space(parts):
    assert got("".join(parts)) == want("".join(parts))


def test_whole_table_and_budget_questions(spark, small_docs):
    table = tc.prefix_table(small_docs, PATH).join(small_docs.select("doc_id", "text"), "doc_id")
    asked = tc.longest_within(tc.tokens_at(table.withColumn("k", F.lit(100)).withColumn("budget", F.lit(37)), "k"), "budget")
    rows = asked.collect()
    assert len(rows) == small_docs.count()
    for r in rows:
        text = r.text or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.n_bytes, r.n_chars) == (len(ids), len(text.encode()), len(text))
    for r in rows[:40]:
        text, counts = r.text or "", want((r.text or "")[:400])
        assert r.tokens_at == (counts[min(100, len(text)) - 1] if text else 0)
        fits = [k for k, v in enumerate(counts, 1) if v <= 37]
        assert r.cut_at == (max(fits) if fits else 0)


def test_edges(spark, edge_docs, no_docs):
    assert tc.prefix_table(no_docs, PATH).count() == 0
    texts = sorted((r.doc_id or 0, r.text or "") for r in edge_docs.collect())
    found = sorted((r.doc_id or 0, r.n_tokens) for r in tc.prefix_table(edge_docs, PATH, stored=False).collect())
    assert found == sorted((i, len(LIBRARY.encode(t, add_special_tokens=False).ids)) for i, t in texts)


LONG = {"kana": "がぱき", "hangul": unicodedata.normalize("NFD", "한국어각"), "dotted": "İ", "accents": "éö'a!́",
        "mixed": "がİ1é!!́'sΣ"}


@pytest.mark.parametrize("kind", LONG)
def test_runs_that_compose_or_grow(kind):
    rng = random.Random(kind)
    units = [u for u, _ in itertools.groupby(LONG[kind])]
    for _ in range(12):
        text = "".join(rng.choice(units) for _ in range(rng.randint(1, 60)))
        assert got(text) == want(text)
    text = LONG[kind] * 80
    assert got(text)[::37] == [len(LIBRARY.encode(text[:k + 1], add_special_tokens=False).ids) for k in range(0, len(text), 37)]


def test_long_runs_take_time_in_proportion():
    for kind, unit in LONG.items():
        text = unit * (100_000 // len(unit))
        start = time.monotonic()
        assert got(text)[-1] == len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert time.monotonic() - start < 20, kind


def test_caches_are_bounded_by_bytes():
    cache = TextCache(lambda key: b"v" * len(key), 10_000, 500)
    for i in range(2000):
        assert cache[f"{i:0100d}"] == b"v" * 100
    assert len(cache) + len(cache.old) <= 2 * (10_000 // 1100 + 2)
    assert cache["x" * 501] == b"v" * 501 and "x" * 501 not in cache
