import random

import numpy as np
import pytest

from lithos.operators.scan import affine_scan, composed, smoothed_series


def test_composed():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        a, b = r.normal(size=n), r.normal(size=n)
        s, expected = 0.7, []
        for x, y in zip(a, b):
            s = x * s + y
            expected.append(s)
        m, c = composed(a, b)
        assert np.allclose(m * 0.7 + c, expected)


@pytest.mark.parametrize("seed, keys", [(1, 1), (2, 3), (3, 200)])
def test_against_a_loop(spark, seed, keys):
    """Keys that go through all ranges, and ranges with many keys; batches of a few rows."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(keys)]), i, r.gauss(0, 1), r.choice([0.5, -0.9, 1.0])) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t int, x double, m double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = {x.t: x.state for x in affine_scan(df, "k", ["t"], df.m, df.x, df.x * 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    state = {}
    for k, t, x, m in sorted(rows, key=lambda y: y[1]):
        state[k] = m * state[k] + x if k in state else 2 * x
        assert found[t] == pytest.approx(state[k], abs=1e-9)
    assert len(found) == 500


def test_smoothing_and_edges(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, None), ("a", 3, 8.0), ("b", 1, 1.0)], "k string, t int, x double")
    assert sorted(map(tuple, smoothed_series(df, "k", ["t"], "x", 0.25).collect())) == [("a", 1, 4.0, 4.0), ("a", 3, 8.0, 5.0), ("b", 1, 1.0, 1.0)]
    assert smoothed_series(df.limit(0), "k", ["t"], "x", 0.25).collect() == []
    assert [r.smooth for r in smoothed_series(df.where("k = 'a'"), None, ["t"], "x", 0.5).orderBy("t").collect()] == [4.0, 6.0]
