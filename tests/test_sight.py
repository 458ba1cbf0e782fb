"""Lines of sight on a long grid, where a thin wall must not fall between two points."""

from lithos.operators import tracking as K
from lithos.operators.grid import Grid


def test_thin_wall_far_away(spark):
    grid = Grid(0.0, 0.0, 1.0, 100.0, 1, 100)
    observers = spark.createDataFrame([("a", 0.5, 0.5)], "rid string, lat double, lon double")
    for wall in (1, 37, 62, 99):
        blocked = spark.createDataFrame([(0, wall)], "lati int, loni int")
        seen = {r.loni: r.sight for r in K.sight_map(blocked, observers, grid).collect()}
        assert seen == {j: j < wall for j in range(100)}
