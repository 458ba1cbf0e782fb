import pytest

from lithos.operators.grid import Grid
from lithos.operators.tracking import direction_weights

GRID = Grid(0.0, 0.0, 10.0, 10.0, 10, 10)


def test_weights(spark):
    """Certain places, so that all draws agree: one walks north, one east, one stands, one is too fast, one is too short."""
    ways = {"n": ((1, 1), (4, 1)), "e": ((2, 2), (2, 8)), "w": ((2, 8), (2, 2)), "-": ((5, 5), (5, 5)), "fast": ((0, 0), (9, 9))}
    rows = [(sid, t, *place, 1.0) for sid, places in ways.items() for t, place in zip((0, 40), places)]
    rows += [("one", 0, 1, 1, 1.0), ("short", 0, 1, 1, 1.0), ("short", 35, 4, 1, 1.0)]
    pmf = spark.createDataFrame(rows, "sid string, t long, lati int, loni int, p double")
    boxes = spark.createDataFrame([(0, -1.0, 4.5, -1.0, 4.5), (1, -1.0, 4.5, 5.5, 10.0), (2, 4.5, 10.0, 4.5, 5.5)], "sector int, s double, n double, w double, e double")
    out = {(r.sector, r.direction): r.weight for r in direction_weights(pmf, boxes, GRID, 10.0, 3).collect()}
    # every draw names both ends; half of the draws are backward and turned round, which makes east of both e and w
    assert out == {(0, "N"): pytest.approx(2.0), (0, "E"): pytest.approx(1.0), (0, "W"): pytest.approx(1.0), (1, "E"): pytest.approx(1.0), (1, "W"): pytest.approx(1.0), (2, "-"): pytest.approx(2.0)}
