import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from citeloom.llm import token_alignment as T

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
TOOLS = T.Vocabularies(*PATHS)

ODD = ["a", " ", "  ", "a  b", " a", "a ", "\n", "\n\n", "a\n\nb", "a\n b", "a \nb", "\t", "a\tb", "a\t b", "a\t\t b", "a\r\nb", "});\r\n\r\n x", "\x1c", "!\x1c ?",
       "a\xa0b", "\xa0 b", "　 x", "x   y", "don't 'S we'll", "naïve café é", "日本語 テスト", "\U0001f600\U0001f600 ok", "a\x00b", "﻿x", "<s>x</s> <unk>",
       "<|endoftext|> a <|endoftext|>", "<0x41>", "a▁b", "▁", "1234567 89", "x" * 400, "ab" * 300 + " " + "ab" * 300, " " * 50 + "a", "   \n   \n", "end.\nThe", "é" * 90, "​ ‍"]


def plain(text):
    """Groups of (A ids, B ids), straight from the libraries."""
    if not text:
        return []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text, num_threads=1)
    bytes_a, bytes_b = [TOOLS.bytes_a[i] for i in ids_a], [B.id_to_piece(i).replace("▁", " ").encode() if not B.is_byte(i) else bytes([int(B.id_to_piece(i)[3:-1], 16)]) for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, left, right, i, j, a, b = [], [], [], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if a <= b:
            left.append((ids_a[i], a, a + len(bytes_a[i])))
            a, i = a + len(bytes_a[i]), i + 1
        else:
            right.append((ids_b[j], b, b + len(bytes_b[j])))
            b, j = b + len(bytes_b[j]), j + 1
        if a == b:
            out.append((left, right))
            left, right = [], []
    return out


def links(groups):
    return [(x[0], y[0]) for left, right in groups for x in left for y in right if x[1] < y[2] and y[1] < x[2]]


def brute(docs):
    groups = [plain(t) for _, t in docs]
    counts = Counter(p for g in groups for p in links(g))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), g in zip(docs, groups):
        own = links(g)
        text = ";".join(",".join(str(x[0]) for x in left) + "|" + ",".join(str(x[0]) for x in right) for left, right in g)
        out.append((i, sum(len(left) for left, _ in g), sum(len(right) for _, right in g), len(g), len(own), sum(counts[p] == best[p[1]] for p in own),
                    sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def check(docs, **options):
    rows = T.align(docs, *PATHS, **options).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block_bytes", [T.BLOCK_BYTES, 5000])
def test_table(small_docs, block_bytes):
    check(small_docs, block_bytes=block_bytes)


def test_odd_texts(spark):
    check(spark.createDataFrame(list(enumerate(ODD + [" ".join(ODD), "\n".join(ODD[:-3])])), "doc_id long, text string"))


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert T.align(no_docs, *PATHS).collect() == []


def test_same_bytes_apart_are_counted_with_the_vector(spark):
    """Pairs of the identity map that also overlap in shifted places have one count."""
    check(spark.createDataFrame([(1, "aaaa aaaaa aaaaaaa aa a"), (2, "eeeeee eeeee eee ee e"), (3, "a a a aa aa")], "doc_id long, text string"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 　ab'sAZ09.,!é́日\U0001f600<|>_"), max_size=40))
def test_units_are_independent(text):
    if text:
        units = TOOLS.units(" " + text)
        assert "".join(units) == " " + text
        assert sum(TOOLS.ids_a(units), []) == A.encode(" " + text, add_special_tokens=False).ids
        assert sum(TOOLS.ids_b(units), []) == B.encode(text, num_threads=1)


def test_blocks_leave_one_by_one(spark):
    """A task holds one block at a time: counts of one-to-one groups follow in a block of their own, without documents."""
    import public_tokenizers

    from citeloom.llm import token_alignment as TA

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 40) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    rows = TA.alignment_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), block_bytes=2000).collect()
    carry = [r for r in rows if len(r["vector"])]
    assert len(carry) == 1 and carry[0]["doc_id"] == [] and sum(carry[0]["vector"]) > 0
    assert sorted(i for r in rows for i in r["doc_id"]) == list(range(60))


def test_blocks_are_written_in_small_row_groups(spark, small_docs, monkeypatch):
    """A task makes many blocks of many MB, and a row group is held as a whole by who writes it and who reads it."""
    import glob
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from citeloom import session

    made, keep = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name, **options: made.append((name, options)) or keep(df, name, **options))
    T.align(small_docs, *PATHS)
    assert ("align-blocks", session.LARGE_ROWS) in made

    def large(batches):
        for _ in batches:
            for _ in range(12):
                yield pa.RecordBatch.from_arrays([pa.array([os.urandom(4 << 20)])], ["held"])

    rows = spark.range(1, numPartitions=1).mapInArrow(large, "held binary")
    folder = session.materialize(rows, "large-rows", **session.LARGE_ROWS).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    sizes = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in glob.glob(f"{folder}/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 24 << 20
