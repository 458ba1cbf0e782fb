import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lithos.llm.filter_audit as A
from lithos.llm.scanning import Scanner

WORDS = st.text(st.sampled_from("aB# \t\n\x0b\x1c\xa0é日😀"), max_size=40)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def scan(scanner, texts):
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    return scanner.counts(np.frombuffer(b"".join(data), dtype=np.uint8), bounds).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=8), st.sampled_from([1, 5, 16, 1 << 20]), st.booleans())
def test_counts(texts, at_once, weak):
    # weights that are all the same make most words of one length clash
    scanner = Scanner(at_once, np.full(256, 3, dtype=np.uint64) if weak else None)
    assert scan(scanner, texts) == [plain(t) for t in texts]


def test_long_texts():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcXé", k=r.choice([1, 2, 3, 50]))) for _ in range(20_000)) + " " + "y" * 200_000
    assert scan(Scanner(1 << 12), [text, "", text[:100]]) == [plain(text), plain(""), plain(text[:100])]


def by_brute_force(docs, labels):
    """The contract, read plainly: every chain is run document by document."""
    fails, part, marks = [], [], {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    for i, text, source in docs:
        w, d, caps, symbols, n = plain(text or "")
        copy = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in docs)
        fails.append({f for f, x in zip("ABCDE", (w < 50, 100 * d < 65 * w, 100 * caps > 5 * n, symbols > 0, copy)) if x})
        part.append(source or "")
    out, removed_by = {}, Counter()
    for p in set(part):
        rows = [k for k in range(len(docs)) if part[k] == p]
        for order in permutations("ABCDE"):
            left = set(rows)
            for step, f in enumerate(order, 1):
                bad = {k for k in left if f in fails[k]}
                gone = [marks.get(docs[k][0], (False, False)) if docs[k][0] is not None else (False, False) for k in bad]
                left -= bad
                out[p, "".join(order), step] = [len(left), len(bad), sum(f in fails[k] for k in rows) - len(bad), sum(fails[k] == {f} for k in rows), sum(g for g, _ in gone), sum(t for _, t in gone)]
                removed_by[p, f] += len(bad)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(seed, n):
    r = random.Random(seed)
    for i in range(n):
        some = [r.choice(["low", "Cap", "UP", "x#y", "é", *(f"w{k}" for k in range(60))]) for _ in range(r.choice([0, 3, 49, 50, 120]))]
        yield (r.choice([None, i, i, i, i // 2]), r.choice([" ".join(some), " ".join(some), "same text", "", None, "ONLY & CAPS"]), r.choice(["a", "b", "", None]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = list(corpus(seed, 90))
    labels = [(r.randrange(90), r.choice([0, 1, None]), r.choice([0, 1, None])) for r in [random.Random(seed)] for _ in range(60)] + [(None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS n", "'d' AS digest", "3 AS mask", "4 AS n_words")
    out = A.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(found) == len(out) and found == by_brute_force(docs, labels)


def test_counts_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Two two", 5), (2, None, 6)], "doc_id long, text string, `text_` int").selectExpr("*", "1 AS n_words", "2 AS `odd``name`")
    rows = A.text_counts(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "Two two", 5, 2, 2, 2, 1, 0, 7), (2, None, 6, 2, 0, 0, 0, 0, 0)]
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
