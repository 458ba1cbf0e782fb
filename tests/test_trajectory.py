import math
import random

import numpy as np
import pytest

from lithos.operators.trajectory import Walk, most_likely_walk


def by_hand(seen, walk):
    """The best way's log probability and cells, step by step over dicts."""
    moves = {}
    for s, d, p in zip(*walk.edges()):
        moves.setdefault(int(s), []).append((int(d), float(p)))
    now = {s: (float(p) + seen[0][s // 16], [s]) for s, p in enumerate(walk.start())}
    for row in seen[1:]:
        after = {}
        for s, (p, path) in now.items():
            for d, q in moves.get(s, []):
                x = p + q + row[d // 16]
                if d not in after or x > after[d][0]:
                    after[d] = x, [*path, d]
        now = after
    return max(now.values(), key=lambda x: x[0])


@pytest.mark.parametrize("block", [1, 4, 64])
def test_against_steps_by_hand(spark, block):
    r, walk = random.Random(block), Walk(2, 3)
    rows = [(key, t, [r.gauss(0, 3) for _ in range(6)]) for key, n in (("a", 1), ("b", 4), ("c", 5), ("d", 23)) for t in range(n)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    out = most_likely_walk(spark.createDataFrame(shuffled, "key string, t long, logp array<double>"), walk, block).collect()
    assert len(out) == len(rows)
    for key in "abcd":
        logp, path = by_hand([x for k, _, x in rows if k == key], walk)
        found = sorted((x for x in out if x.key == key), key=lambda x: x.t)
        assert all(x.logp == pytest.approx(logp) for x in found)
        assert [(x.lati, x.loni) for x in found] == [divmod(s // 16, 3) for s in path]


def test_moves():
    walk = Walk(3, 3)
    src, dst, logp = walk.edges()
    p = {(int(s), int(d)): math.exp(q) for s, d, q in zip(src, dst, logp)}
    state = lambda i, j, turned, fast: ((i * 3 + j) * 8 + turned) * 2 + fast
    assert p[state(1, 1, 0, 0), state(2, 1, 0, 0)] == pytest.approx(0.6 * 0.8 * 0.9)
    assert p[state(1, 1, 0, 0), state(1, 1, 1, 1)] == pytest.approx(0.4 * 0.1 * 0.1)
    assert p[state(0, 1, 0, 1), state(2, 1, 7, 1)] == pytest.approx(0.05 * 0.1 * 0.9)
    assert (state(1, 1, 0, 1), state(1, 1, 0, 1)) not in p and (state(2, 1, 0, 0), state(2, 1, 0, 0)) in p
    assert np.exp(walk.start()).sum() == pytest.approx(1)


def test_empty(spark):
    assert most_likely_walk(spark.createDataFrame([], "key int, t long, logp array<double>"), Walk(2, 2)).collect() == []


@pytest.mark.parametrize("block,longest", [(1, 3), (4, 0), (4, 4), (64, 20)])
def test_short_and_long_records(spark, block, longest):
    """Short records go side by side and long ones by blocks, with the same ways; one has no key, some begin in other batches."""
    r, walk = random.Random(block), Walk(2, 3)
    lengths = {**{f"k{i}": r.randrange(1, 9) for i in range(40)}, "long": 30, "edge": longest + 1, None: 6}
    rows = [(key, t, [r.gauss(0, 3) for _ in range(6)]) for key, n in lengths.items() for t in range(n)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = most_likely_walk(spark.createDataFrame(rows, "key string, t long, logp array<double>"), walk, block, longest).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows)
    for key, n in lengths.items():
        logp, path = by_hand([x for k, _, x in sorted(rows, key=lambda x: x[1]) if k == key], walk)
        found = sorted((x for x in out if x.key == key), key=lambda x: x.t)
        assert len(found) == n and all(x.logp == pytest.approx(logp) for x in found)
        assert [(x.lati, x.loni) for x in found] == [divmod(s // 16, 3) for s in path]


def test_short_records_need_no_matrices(spark, monkeypatch):
    from lithos.operators import trajectory

    monkeypatch.setattr(trajectory.Steps, "product", None)
    monkeypatch.setattr(trajectory, "_by_blocks", None)
    monkeypatch.setattr(trajectory, "SIDE_BY_SIDE", 50)
    rows = [(k, t, [0.0, float(t % 3), 0.5, float(k % 2)]) for k in range(30) for t in range(70)]
    assert most_likely_walk(spark.createDataFrame(rows, "key int, t long, logp array<double>"), Walk(2, 2)).count() == 2100
