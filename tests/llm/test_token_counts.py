import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

import lithos.llm.token_counts as T


def library(pieces, byte_fallback=False):
    """The Unigram model of the library over whole texts, with spaces marked."""
    some = [(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces, *some], 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    return t


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_real_vocabulary(byte_fallback):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert T.falls_back(path)
    pieces = T.vocabulary(path)
    ours, theirs, r = T.Counter(pieces, byte_fallback), library(pieces, byte_fallback), random.Random(2)
    assert ours.apart and T.units("a    b ▁c") == ["a", "▁▁▁b", "▁c"]
    texts = ["a    b      c def main():\n        return  x", "   ", "  x", " x", "x  "]
    for _ in range(400):
        texts.append("".join(r.choice(["the", "a", " ", "  ", "     ", "\n", "é", "日", "ing", "😀", "\t", "xq", "▁", "of", "\U00012345"]) for _ in range(r.randint(0, 30))))
    for x in texts:
        assert ours.counts([x])[0][0] == len(theirs.encode(x, add_special_tokens=False).ids), x


def test_ties_of_small_vocabularies():
    r = random.Random(7)
    for k in range(150):
        letters = "ab▁"[: 2 + k % 2]  # with every other vocabulary, pieces go on from words into spaces
        pieces = list(dict([("▁", -1.0)] + [("".join(r.choice(letters) for _ in range(r.randint(1, 4))), r.choice([-1.0, -2.0, -0.5, -3.0])) for _ in range(r.randint(1, 8))]).items())
        ours, theirs = T.Counter(pieces), library(pieces)
        for _ in range(10):
            x = "".join(r.choice("abc ") for _ in range(r.randint(0, 15)))
            assert ours.counts([x])[0][0] == len(theirs.encode(x, add_special_tokens=False).ids), (pieces, x)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -2.5)]
    ours, fresh = T.Counter(pieces), T.Counter(pieces)
    for x in ["ab a b", "aa bb ab ba", "ab a", "b b b", "aab abb"] * 3:
        assert ours.counts([x])[0] == (sum(fresh.word("▁" + w)[0] for w in x.split(" ")), sum(fresh.word("▁" + w)[1] for w in x.split(" ")))


def test_table(spark):
    pieces = [("▁", -1.0), ("a", -1.0), ("▁a", -1.5)]
    rows = [(1, "a a", 9), (2, None, 9), (3, "", 9), (None, "zz", 9), (1, "a a", 9), (4, "a" * 20_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(((r.doc_id, r.n_tokens, r.score) for r in T.token_counts(df, pieces).collect()), key=repr)
    assert found == sorted([(1, 2, -3.0), (2, 0, 0.0), (3, 0, 0.0), (None, 2, -24.0), (1, 2, -3.0), (4, 20_000, -1.5 - 19_999.0)], key=repr)
    assert T.token_counts(df.limit(0), pieces).collect() == []
