import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import lithos.llm.bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
POOLS = ["abcdefghij", "theinganersto", "'strelvd!?.,", "éèüßÅÄ", "é̀å", "0123", "İIŞ", "日本語", " \t\x85", "<|endoftext|>", "😀👍", "\n", "".join(map(chr, [0x110C, 0x1161, 0x11AF, 0x11B0, 0x1112, 0x1175])), "m" + "".join(map(chr, [0x302, 0x31F, 0x32D, 0x30A, 0x338])) + "ae<>", "각하훍", "".join(map(chr, [0xF71, 0xF72, 0xF73, 0xF40, 0x344, 0x345, 0x3B1])), "'s'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n, sizes=(0, 5, 40, 700, 3000)):
    r = random.Random(seed)
    for _ in range(n):
        pool = "".join(r.choice(POOLS) for _ in range(r.choice([1, 2, 4])))
        yield "".join(r.choice(pool) for _ in range(r.choice(sizes)))


def by_parts(codec, text, size):
    parts = [B.Part.of(codec, text[q : q + size]) for q in range(0, len(text), size)]
    while len(parts) > 1:
        parts = [parts[q].then(codec, parts[q + 1]) if q + 1 < len(parts) else parts[q] for q in range(0, len(parts), 2)]
    return parts[0].all_ids(codec).tolist() if parts else []


@pytest.mark.parametrize("leaf, window", [(8, 1), (64, 2), (512, 8)])
def test_trees_and_parts(library, monkeypatch, leaf, window):
    monkeypatch.setattr(B, "LEAF", leaf)
    monkeypatch.setattr(B, "WINDOW", window)
    codec = B.Codec(B.read_spec(PATH))
    for n, t in enumerate(texts(leaf, 400)):
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.ids([t])[0].tolist() == ids
        for size in (3, 7, 97) if n % 10 == 0 or len(t) < 50 else (97,):
            assert by_parts(codec, t, size) == ids, (size, t)


def test_composition_at_every_cut(library):
    codec = B.Codec(B.read_spec(PATH))
    some = ["m\u110c\u0302\u031f\u11af\u11b0\u032d\u030a", "0123456789a<|endoftext|>\u0338b" * 3, "<|END<|endoftext|><|startoftext|>>\u0338", "\u1112\u1161\u11ab\u1100\u1173\u11af" * 3, "\u0f73\u0f71x\u0344", "e\u0301\u0323 \u0308a\u030a"]
    for t in some:
        ids = library.encode(t, add_special_tokens=False).ids
        for size in range(16 if "<|" in t else 1, len(t) + 1):
            assert by_parts(codec, t, size) == ids, (size, t)
    for unit in ("\u1112\u1161\u11ab", "a\u0302\u031f", "\u1100\u1161o\u0323\u0302"):
        t = unit * 600
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.ids([t])[0].tolist() == ids and by_parts(codec, t, 100) == ids


def test_query_shape_and_long_texts(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(9, 25))] + [(100, None), (101, "a" * 9000), (101, "a" * 9000), (None, "Null id. Ends")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, B.bpe_digests(df, PATH).collect()), key=repr) == sorted(expected, key=repr)
    cut = B.bpe_encode(df, PATH, piece=100)
    ids = [(r.doc_id, r.text, r.ids) for r in cut.collect()]
    assert sorted(ids, key=repr) == sorted(((i, t, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    back = {r.doc_id: r.decoded for r in B.bpe_decode(cut, PATH).collect()}
    assert back[101] == library.decode(library.encode("a" * 9000, add_special_tokens=False).ids, skip_special_tokens=False)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "x", 3)], "doc_id long, text string, ids string, key int")
    row = B.bpe_encode(df, PATH).first()
    assert isinstance(row.ids, list) and row.key == 3
    assert B.bpe_encode(df.limit(0), PATH).collect() == []


def test_batches(library, monkeypatch):
    """Texts of a batch, also where it is dealt out by characters, with special tokens, equal texts and empty ones."""
    monkeypatch.setattr(B, "LEAF", 64)
    some = [*texts(5, 150), "", "<|endoftext|>", "a <|startoftext|><|endoftext|> b<|endoftext|>", " \n ", "a b", "Ab. Ü!?& 'stop it's 4²", "a b"]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    for at_once in (1, 500, B.AT_ONCE):
        monkeypatch.setattr(B, "AT_ONCE", at_once)
        codec = B.Codec(B.read_spec(PATH))
        assert [x.tolist() for x in codec.ids(some)] == want
    assert codec.ids([]) == []


def test_runs_of_a_batch_are_looked_up_once():
    """Lookups grow with a batch's distinct runs, not with its words; parts of runs that were seen aren't encoded again."""
    asked, encoded = [], []

    class Counted(B.Kept):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    codec = B.Codec(B.read_spec(PATH))
    codec.runs_ids, tokenize = Counted(codec.run), codec.tokenize
    codec.tokenize = lambda part: encoded.append(part) or tokenize(part)
    codec.ids([f"the words of the text {k}\nare the words" for k in range(500)])
    assert [asked.count(w) for w in "the words of text are".split()] == [1] * 5
    codec.ids(["the*** (words) the*** text's"])
    assert encoded.count("the") == encoded.count("words") == encoded.count("text") == encoded.count("***") == 1
