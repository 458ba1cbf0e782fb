import random
import re

import numpy as np
import pyarrow as pa
import pytest

import lithos.llm.near_dedup as N
from lithos.llm.near_dedup import near_dedup, word_hashes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_brute_force(rows, size):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 40, 80]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, r.choice([" ", "\n", "  "]).join(t).replace("w1", r.choice(["w1", "W1"]))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é É x"), (n + 6, "é É x")]


@pytest.mark.parametrize("seed, size, minor", [(1, 2, 64), (2, 5, 64), (3, 2, 0), (4, 5, 0)])
def test_against_brute_force(spark, monkeypatch, seed, size, minor):
    monkeypatch.setattr(N, "MINOR", minor)
    monkeypatch.setattr(N, "FEW", minor)
    rows = corpus(seed)
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    assert sorted(map(tuple, found)) == by_brute_force(rows, size)


def test_a_band_of_different_texts_ends(spark, monkeypatch):
    """Texts that share half of their words meet in bands as different components."""
    monkeypatch.setattr(N, "MINOR", 0)
    monkeypatch.setattr(N, "STRANGERS", 7)
    monkeypatch.setattr(N, "FEW", 1)
    r = random.Random(5)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(i, common + " " + " ".join(f"x{r.randrange(10**6)}" for _ in range(20))) for i in range(40)]
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=2, per=2, bands=6).collect()
    assert sorted(map(tuple, found)) == by_brute_force(rows, 2)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, 2), (5, "a b c d e f", 1, 2), (5, "a b c d e f", 1, 2), (None, "other words here now", 3, 4), (7, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, k1 int")
    found = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup(df).collect()}
    assert found == {(None, 5, False, 2), (5, 5, True, 2), (None, None, True, 1), (7, 7, True, 0)}
    assert near_dedup(df.limit(0)).collect() == []


def test_word_hashes_follow_words():
    texts = ["Ab cd\nab", None, "", "x" * 50 + " " + "x" * 49 + " ab", " ab ", "É é"]
    hashes, ends = word_hashes(pa.array(texts))
    assert list(ends) == [3, 3, 3, 6, 7, 9]
    assert hashes[0] == hashes[2] == hashes[5] == hashes[6] and len({*hashes.tolist()}) == 6
    again, _ = word_hashes(pa.array(["zz", *texts]).slice(1))
    assert again.tolist() == hashes.tolist()


def test_blocks_of_long_texts_need_little_memory():
    """256 sets of 20,000 shingles in a block: what is shared is counted in the size of the sets."""
    import tracemalloc

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 62, 20_000)) for _ in range(256)]
    others = [np.unique(np.concatenate([sets[k][:15_000], sets[k + 1][:100], r.integers(0, 1 << 62, 3_000)])) for k in range(4)]
    tracemalloc.start()
    found = list(N.shared_counts(sets, others))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    for n, other in zip(found, others):
        assert n.tolist() == [len(np.intersect1d(x, other)) for x in sets]
    assert list(N.shared_counts([np.zeros(0, np.int64)], [sets[0]]))[0].tolist() == [0]
