import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lithos.llm.vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows, parts=4, entries=256, rounds=4):
    ok = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ok[0][1]) // parts
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in ok:
                members.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    codes = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in ok]
    errors = [sum(far(cut(v, p), books[p][k]) for p, k in enumerate(c)) for (_, v, _), c in zip(ok, codes)]
    by_label = {}
    for (_, _, label), e in zip(ok, errors):
        by_label[label] = by_label.get(label, 0) + e
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in c), e, by_label[label], said) for (i, _, label), c, e in zip(ok, codes, errors)), key=repr)


def vectors(seed, n, dims, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    for i in range(n):
        yield (i, [float(np.float32(x + r.gauss(0, r.choice(spread)))) for x in r.choice(centres)], r.choice([None, 1, 1, 2]))


@pytest.mark.parametrize("seed, dims, entries, spread", [(1, 16, 24, [0.1]), (2, 8, 256, [0, 0.001]), (3, 4, 16, [0, 1]), (4, 64, 10, [0.3])])
def test_against_brute_force(spark, seed, dims, entries, spread):
    rows = list(vectors(seed, 300, dims, spread)) + [(400, None, 1), (401, [float("nan")] * dims, 1), (402, [None] * dims, 1), (403, [], 2), (404, [1.0] * (dims + 4), 2), (None, [0.25] * dims, 2), (7, [0.5] * dims, None)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "'x' AS code", "3 AS part", "4 AS error").repartition(3)
    out = V.vector_codes(df, entries=entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, out), key=repr) == by_brute_force(rows, entries=entries)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 3), st.integers(1, 6))
def test_bounds_hold(seed, entries, width, most):
    """Small whole numbers make many ties; rounds of random moves."""
    r = np.random.default_rng(seed)
    x = r.integers(-most, most + 1, (40, width))
    book, state = r.integers(-most, most + 1, (entries, width)), (None, None, None)
    before = None
    for _ in range(5):
        *state, _ = V.Moves(book, before).assign(x, *state)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] ** 2 >= d.min(axis=1) - 1e-6).all()
        if entries > 1:
            d[np.arange(40), state[0]] = 1 << 40
            assert (np.maximum(state[2], 0) ** 2 <= d.min(axis=1) + 1e-6).all()
        before, book = book, book + r.integers(-1, 2, book.shape) * r.integers(0, 2, (entries, 1))


def test_bounds_save_scans(spark):
    rows = list(vectors(5, 600, 16, [0.05]))
    whole = [(i, str(label), [math.floor(1024 * x) for x in v]) for i, v, label in rows]
    _, _, scanned = V.train(spark.createDataFrame(whole, "id long, label string, v array<long>"), entries=12)
    assert scanned[0] == 4 * 600 and scanned[-1] < 600


def test_large_numbers_and_empty_tables(spark):
    x, y = np.array([[2**28, -(2**28)], [0, 1]]), np.array([[-(2**28), 2**28]])
    assert V.squared(x, y).tolist() == [[2 * 2**58], [2**56 + (2**28 - 1) ** 2]]
    with pytest.raises(ArithmeticError):
        V.squared(x * 8, y)
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.vector_codes(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0] * 5, 1)], SCHEMA)).collect() == []
    assert [r.code for r in V.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 1), (1, [1.0] * 4, 1)], SCHEMA)).collect()] == ["00000000"] * 2
