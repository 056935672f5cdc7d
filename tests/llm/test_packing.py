import zlib

import brute
import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from citeloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, capacity=1024):
    """docs: list of (doc_id, text)"""
    want = sorted(((i if i is not None else -1), len(ids)) for i, ids in ((i, ids_of(t)) for i, t in docs))
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    for own in brute.by_group(rows, "sequence_id").values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert sum(r.length for r in own) <= capacity
    checks = {}
    for i, text in docs:
        ids = np.array(ids_of(text), "<u4")
        for at in range(0, len(ids), capacity):
            part = ids[at:at + capacity]
            checks.setdefault((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)), 0)
            checks[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    found = {}
    for r in rows:
        k = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        found[k] = found.get(k, 0) + 1
    assert found == checks


def test_table(spark, small_docs):
    rows = packing.pack_documents(small_docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in small_docs.collect()])
    sequences = len({r.sequence_id for r in rows})
    assert sequences * 1024 <= 1.02 * sum(r.length for r in rows) + 1024


def test_edges(edge_docs, no_docs):
    check(packing.pack_documents(edge_docs, PATH).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_groups_and_filled_sequences(spark, small_docs):
    pieces = packing.token_pieces(small_docs, PATH, capacity=64)
    packed = packing.pack(pieces.drop("_ids"), capacity=64, group_pieces=200)
    assert packed.select((packed.sequence_id.bitwiseAND(~((1 << 24) - 1)))).distinct().count() > 3
    filled = packing.fill_sequences(packed, pieces, 64).collect()
    assert sum(len(r.ids) for r in filled) == sum(len(ids_of(r.text)) for r in small_docs.collect())
    assert sum(r.ids.count(0) for r in filled) >= small_docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
def test_tree_gives_first_fit_decreasing(lengths):
    where, offset = packing.first_fit_decreasing(np.array(lengths), 32)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_ = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if bin_ == len(room):
            room.append(32)
        want[i] = (bin_, 32 - room[bin_])
        room[bin_] -= lengths[i]
    assert [(int(where[i]), int(offset[i])) for i in range(len(lengths))] == [want[i] for i in range(len(lengths))]


def test_encoder_equals_the_library():
    for text in ["", " ", "a  b\n\n c", "don't<|endoftext|>x", "日本 é\xa0\x85\x1c", "x" * 5000, "İ ½ ²", "‍👩", "a\tb \n", "'s'S"]:
        assert packing.encoder(PATH).encode(text).tolist() == ids_of(text)[:-1]
