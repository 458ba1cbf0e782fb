import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lithos.operators import colours as C

BOUNDS = [(0.0, 256.0), (0.0, 256.0), (0.0, 100.0)]


def uniform(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def way(x, tree, depth, seed):
    low, high, bits = [a for a, _ in BOUNDS], [b for _, b in BOUNDS], ""
    for _ in range(depth):
        axis = int(uniform(seed, "axis", tree, bits) * 3)
        at = low[axis] + uniform(seed, "place", tree, bits) * (high[axis] - low[axis])
        if x[axis] >= at:
            low[axis], bits = at, bits + "1"
        else:
            high[axis], bits = at, bits + "0"
    return bits


def test_forest_against_one_by_hand(spark):
    r = random.Random(1)
    point = lambda: [r.uniform(0, 256), r.uniform(0, 256), r.uniform(0, 100)]
    seen = [(p, "red" if p[0] > 128 else "other") for p in (point() for _ in range(60))]
    asked = [(i, point()) for i in range(80)]
    counts = C.counted(spark.createDataFrame(seen, "x array<double>, cls string"), BOUNDS, 3, 6, 7)
    by_hand = Counter((t, way(x, t, 6, 7)[:k], c) for x, c in seen for t in range(3) for k in range(7))
    assert {(x.tree, x.node, x.cls): x.n for x in counts.collect()} == dict(by_hand)
    found = {x.id: x for x in C.classified(spark.createDataFrame(asked, "id int, x array<double>"), counts, BOUNDS, 3, 6, 7).collect()}
    for i, x in asked:
        votes = Counter()
        for t in range(3):
            node = way(x, t, 6, 7)
            while not any((t, node, c) in by_hand for c in ("red", "other")):
                node = node[:-1]
            of = by_hand[t, node, "red"] + by_hand[t, node, "other"]
            for c in ("red", "other"):
                votes[c] += by_hand[t, node, c] / of / 3
        cls = min(c for c in votes if votes[c] > max(votes.values()) - 1e-9)
        assert (found[i].cls, found[i].share) == (cls, pytest.approx(votes[cls]))


def test_counts_add_up_and_empty(spark):
    rows = spark.createDataFrame([([float(i), 5.0, 5.0], i % 2) for i in range(20)], "x array<double>, cls int")
    halves = [C.counted(rows.where(f"cls = {k}"), BOUNDS, 2, 4, 1) for k in (0, 1)]
    both = {(x.tree, x.node, x.cls): x.n for h in halves for x in h.collect()}
    assert both == {(x.tree, x.node, x.cls): x.n for x in C.counted(rows, BOUNDS, 2, 4, 1).collect()}
    none = C.counted(rows.limit(0), BOUNDS, 2, 4, 1)
    assert none.collect() == [] and C.classified(rows.selectExpr("cls AS id", "x"), none, BOUNDS, 2, 4, 1).collect() == []


def test_missing_values_and_many_points_of_a_leaf(spark):
    """Missing coordinates lead down and leave the box as it is, NaN leads up; nodes are made once."""
    def odd_way(x, tree, depth, seed):
        low, high, bits = [a for a, _ in BOUNDS], [b for _, b in BOUNDS], ""
        for _ in range(depth):
            axis = int(uniform(seed, "axis", tree, bits) * 3)
            at = low[axis] + uniform(seed, "place", tree, bits) * (high[axis] - low[axis])
            v = x[axis] if x is not None and axis < len(x) else None
            above = v is not None and (v != v or v >= at)
            if above:
                low[axis] = at
            elif v is not None:
                high[axis] = at
            bits += "1" if above else "0"
        return bits

    r = random.Random(3)
    points = [[r.choice([None, float("nan"), r.uniform(0, 256)]) for _ in range(3)] for _ in range(60)] + [None, [7.0], []]
    rows = spark.createDataFrame(list(enumerate(points)), "id int, x array<double>")
    found = {(x.id, x.tree): x.way for x in C.ways(rows, BOUNDS, 3, 7, 5).collect()}
    assert found == {(i, t): odd_way(x, t, 7, 5) for i, x in enumerate(points) for t in range(3)}

    same = spark.range(5000).selectExpr("CAST(id AS INT) AS id", "array(10.0D, 20.0D, 30.0D + id % 2) AS x", "id % 3 AS cls")
    counts = C.counted(same, BOUNDS, 2, 4, 1)
    assert C.classified(same, counts, BOUNDS, 2, 4, 1).count() == 5000
    tree = C.Tree(BOUNDS, 0, 1)
    tree.ways(np.full((5000, 3), 10.0), np.zeros((5000, 3), dtype=bool), 6)
    assert len(tree.bits) == 7  # a node a level, however many points
