import hashlib
import random

import pytest

from lithos.operators import trees as G


def hexed(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12]


def uniform(*parts):
    return (int(hexed(*parts), 16) + 0.5) / 2**48


def tree_by_hand(rows, features, tries, capacity, levels, norm, seed, tree=0):
    """One tree, node by node: rows are (id, x, y, times)."""
    nodes, open_ = {}, [(1, rows, 0)]
    while open_:
        node, here, depth = open_.pop()
        bag = [r for r in here if r[3]]
        n = sum(r[3] for r in bag)
        best = None
        for k in range(tries) if n > capacity and depth < levels else ():
            f = int(uniform(seed, "feature", tree, node, k) * features)
            a, b = (min(bag, key=lambda r: hexed(seed, "row", tree, node, k, s, r[0]))[1][f] for s in (0, 1))
            split = a + uniform(seed, "split", tree, node, k) * (b - a)
            sides = [r for r in bag if r[1][f] < split], [r for r in bag if r[1][f] >= split]
            sizes = [sum(r[3] for r in s) for s in sides]
            if min(sizes) and min(sizes) >= n / 16:
                error = 0.0
                for s, size in zip(sides, sizes):
                    mean = sum(r[2] * r[3] for r in s) / size
                    error += sum(r[3] * abs(r[2] - mean) ** norm for r in s)
                best = min(best or (error, k, f, split), (error, k, f, split))
        if best:
            nodes[node] = ("split", best[2], best[3])
            open_ += [(2 * node, [r for r in here if r[1][best[2]] < best[3]], depth + 1), (2 * node + 1, [r for r in here if r[1][best[2]] >= best[3]], depth + 1)]
        elif bag:
            nodes[node] = ("leaf", n, sum(r[2] * r[3] for r in bag) / n)
    return nodes


def plain(nodes, tree=0):
    return {r.node: ("leaf", r.n, pytest.approx(r.mean)) if r.feature is None else ("split", r.feature, r.split) for r in nodes.collect() if r.tree == tree}


def table(seed, n):
    r = random.Random(seed)
    return [(i, [r.choice([0.0, 1.0, 2.0]), r.random(), 5.0], r.gauss(0, 1) + i % 3) for i in range(n)]


@pytest.mark.parametrize("seed, norm", [(1, 2.0), (2, 1.0), (3, 1.5)])
def test_tree_against_one_by_hand(spark, seed, norm):
    rows = table(seed, 300)
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, [1.0, None, 2.0], 1.0), (902, [1.0, 1.0, 1.0], None)], "id long, x array<double>, y double")
    nodes, placed = G.grown(df, 3, tries=4, capacity=15, levels=6, norm=norm, seed=seed)
    by_hand = tree_by_hand([(*r, 1) for r in rows], 3, 4, 15, 6, norm, seed)
    assert plain(nodes) == by_hand
    assert placed.count() == 300
    # rows that go down the finished tree end where they were put
    where = {r.id: r.node for r in placed.collect()}
    said = {r.id: r.prediction for r in G.predict(nodes, df.where("id < 900").select("id", "x")).collect()}
    assert all(by_hand[where[i]][2] == pytest.approx(said[i]) for i in range(300))


def test_forest(spark):
    rows = table(4, 200)
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    nodes, placed = G.grown(df, 3, trees=5, tries=3, capacity=20, levels=4, seed=9)
    steps = G.poisson_steps()
    assert sum(1 for _ in steps) == G.MOST_TIMES and steps[0] == pytest.approx(0.3678794)
    for t in range(5):
        bag = [(*r, sum(uniform(9, "bag", t, r[0]) >= s for s in steps)) for r in rows]
        assert plain(nodes, t) == tree_by_hand(bag, 3, 3, 20, 4, 2.0, 9, t)
    oob = G.out_of_bag(nodes, placed).collect()
    assert 0.25 < len(oob) / 1000 < 0.5 and {r.tree for r in oob} == set(range(5))


def test_edges(spark):
    none = spark.createDataFrame([], "id long, x array<double>, y double")
    nodes, placed = G.grown(none, 2)
    assert nodes.collect() == [] and placed.collect() == []
    same = spark.createDataFrame([(i, [1.0], float(i)) for i in range(50)], "id long, x array<double>, y double")
    assert [(r.node, r.n, r.mean) for r in G.grown(same, 1)[0].collect()] == [(1, 50, 24.5)]
