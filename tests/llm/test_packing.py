import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import lithos.llm.packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_looking(sizes, capacity):
    """First-fit decreasing by looking through all bins."""
    room, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
            out.append([])
        room[b] -= sizes[i]
        out[b].append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.integers(0, 5))
def test_bins(sizes, room):
    assert P.first_fit_decreasing(sizes, 64) == by_looking(sizes, 64)
    places = [set() for _ in sizes]
    for b in P.packed(sizes, 64, room):
        used = sum(n for _, _, n in b)
        assert all(n > 0 for _, _, n in b) and (64 - room <= used <= 64 or used & (used - 1) == 0)
        for i, start, n in b:
            span = set(range(start, start + n))
            assert not places[i] & span
            places[i] |= span
    assert places == [set(range(n)) for n in sizes]


def check(rows, out, length, room, groups):
    """Every document's ids lie in one piece each, every sequence is gapless and padded little."""
    library = Tokenizer.from_file(PATH)
    want = sorted(((i is None, i or 0), tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and (at >= length - room or at & (at - 1) == 0)
        padded += at < length and at & (at - 1) == 0
    assert padded <= groups * length.bit_length()
    for key in {k for k, _ in want}:
        docs = [x for k, x in want if k == key]
        pieces = by_doc.pop(key)
        assert sum(p.length for p in pieces) == sum(map(len, docs))
        if len(docs) == 1:
            ids, at = docs[0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            crc = lambda p, x: zlib.crc32(np.array(x[p.start : p.start + p.length], dtype="<u4").tobytes())
            assert all(any(p.doc_tokens == len(x) and p.ids_crc32 == crc(p, x) for x in docs) for p in pieces)
    assert not by_doc


@pytest.mark.parametrize("length, group", [(64, 20), (2048, 2048), (1, 5)])
def test_against_the_library(spark, length, group):
    r = random.Random(length)
    words = "the packing of sequences needs little padding and cuts Zürich 日本語 1999".split()
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 30, 400])))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (7, "again"), (7, "again"), (202, "x" * 5000), (203, "long " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "'t' AS tail", "3 AS `group`", "4 AS __id")
    out = P.pack(df, PATH, length=length, group=group, with_ids=True).collect()
    check(rows, out, length, P.ROOM, -(-len(rows) // group) + 1)
    assert all(r.ids is None or zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df, PATH).collect() == []
    one = P.pack(spark.createDataFrame([(5, "")], "doc_id long, text string"), PATH).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(5, 0, 1, 1, 0)]
