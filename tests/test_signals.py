"""Grids of signals against sums by hand."""

import math
import random

import pytest

from lithos.operators import tracking as K
from lithos.operators.grid import Grid

GRID = Grid(0.0, 0.0, 0.02, 0.03, 2, 3)


def by_hand(rows, observers):
    """p by source, second and cell; None where nothing heard has a strength."""
    ends = {r: (y, x, z) for r, y, x, z in observers}
    cells = [(i, j, (i + 0.5) * 0.01, (j + 0.5) * 0.01) for i in range(2) for j in range(3)]
    heard = {}
    for rid, sid, t, dbm in rows:
        if rid in ends:
            heard.setdefault((sid, t), {}).setdefault(rid, []).append(dbm)
    out = {}
    for key, by in heard.items():
        logp = []
        for _, _, lat, lon in cells:
            total, known = 0.0, False
            for rid, all_of in by.items():
                some = [x for x in all_of if x is not None]
                if some:
                    y, x, z = ends[rid]
                    u, v = math.radians(lat), math.radians(y)
                    flat = 2 * 6372795 * math.asin(math.sqrt(math.sin((u - v) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(lon - x) / 2) ** 2))
                    expected = -30 - 20 * math.log10(max(1.0, math.hypot(flat, z)))
                    total, known = total - len(all_of) * ((sum(some) / len(some) - expected) / 6) ** 2 / 2, True
            logp.append(total if known else None)
        mass = [None if x is None else math.exp(x - max(logp)) for x in logp]
        for (i, j, _, _), m in zip(cells, mass):
            out[*key, i, j] = None if m is None else m / sum(mass)
    return out


@pytest.mark.parametrize("few", [256, 1])
def test_signal_grid(spark, monkeypatch, few):
    """Arrays of cells and rows of cells say the same: several observations of an observer, an unknown one, no strength."""
    r = random.Random(9)
    observers = [("a", 0.0, 0.0, 3.0), ("b", 0.02, 0.03, 0.0), ("c", 0.01, 0.02, 10.0)]
    rows = [(r.choice("abcx"), r.randrange(4), r.randrange(3), r.choice([None, r.uniform(-110, -60)])) for _ in range(80)] + [("a", 9, 0, None), ("x", 9, 1, -70.0)]
    monkeypatch.setattr(K, "FEW_OBSERVERS", few)
    grid = K.signal_grid(spark.createDataFrame(rows, "rid string, sid int, t int, dbm double"), spark.createDataFrame(observers, "rid string, lat double, lon double, z double"), GRID)
    found = {(x.sid, x.t, x.lati, x.loni): x.p for x in grid.collect()}
    expected = by_hand(rows, observers)
    assert set(found) == set(expected) and found[9, 0, 0, 0] is None
    assert all(found[k] == (p if p is None else pytest.approx(p, abs=1e-9)) for k, p in expected.items())


def test_observer_that_stands_twice(spark):
    observers = [("a", 0.0, 0.0, 3.0), ("a", 0.02, 0.03, 0.0)]
    grid = K.signal_grid(spark.createDataFrame([("a", 1, 1, -80.0)], "rid string, sid int, t int, dbm double"), spark.createDataFrame(observers, "rid string, lat double, lon double, z double"), GRID)
    assert grid.count() == 6


def test_no_cell_is_shuffled(spark):
    """Sums of cells are made where their source's second is: no exchange carries cells."""
    observers = spark.createDataFrame([("a", 0.0, 0.0, 3.0)], "rid string, lat double, lon double, z double")
    rows = spark.range(100).selectExpr("'a' AS rid", "id % 7 AS sid", "id AS t", "-80D AS dbm")
    plan = K.signal_grid(rows, observers, GRID)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate") if "Generate" in plan else 0]
    assert "Generate posexplode" in plan and "Aggregate" not in above and "Join" not in above
