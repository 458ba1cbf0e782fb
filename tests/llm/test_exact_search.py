import math
import random

import pytest
from pyspark.sql import functions as F

import lithos.llm.exact_search as X
from lithos.llm.exact_search import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def by_brute_force(rows, every, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q is not None and q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in ok if i != q and len(w) == len(v)]
            for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
                out.append((q, rank, i, -s))
    return sorted(out)


def vectors(seed, n, dims, clusters=3):
    import struct

    r = random.Random(seed)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [f32(x + r.gauss(0, r.choice([0, 0.1, 1]))) for x in r.choice(centres)], 0) for i in range(n)]


@pytest.mark.parametrize("seed, dims, block", [(1, 64, 2048), (2, 5, 7), (3, 1, 16), (4, 33, 40)])
def test_against_brute_force(spark, monkeypatch, seed, dims, block):
    monkeypatch.setattr(X, "CANDIDATES", block)
    monkeypatch.setattr(X, "QUERIES", 4)
    rows = vectors(seed, 150, dims) + [(200, None, 0), (210, [float("nan")] * dims, 0), (220, [None] * dims, 0), (230, [float("inf")] + [0.0] * (dims - 1), 0), (240, [1.0] * (dims + 1), 0), (None, [0.5] * dims, 0)]
    found = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == by_brute_force(rows, 10, 10)


def test_ties_empty_and_few(spark):
    rows = [(i, [0.5, 0.5], 0) for i in range(30)]
    found = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(10))
    assert exact_top_k(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []


def test_bounds_hold():
    import numpy as np

    r = np.random.default_rng(1)
    q, v = r.normal(size=(20, 30)), r.normal(size=(40, 30))
    for n in (1, 4, 16):
        assert (X.statistics(q, n) @ X.statistics(v, n).T >= q @ v.T - 1e-9).all()
