import math

import pytest
from pyspark.sql import functions as F

from lithos.operators import features as X
from lithos.sources.text import settings


def test_coordinates(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], "lat double, lon double")
    rows = X.planarised(p).orderBy("lon").collect()
    assert (rows[0].x, rows[0].y) == (0, 0) and rows[1].x == pytest.approx(math.radians(1) * 6372795)
    turned = X.more_bases(spark.createDataFrame([(1.0, 0.0)], "x double, y double"), [math.pi / 2]).first()
    assert turned.x_1 == pytest.approx(0) and turned.y_1 == pytest.approx(-1)


def test_noise_is_normal_and_repeats(spark):
    df = spark.range(4000).select(X.noise(3, F.col("id")).alias("z"))
    m, s = df.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert abs(m) < 0.06 and abs(s - 1) < 0.05
    assert df.agg(F.sum("z")).first() == df.agg(F.sum("z")).first()
    pts = spark.range(50).select("id", (F.col("id") / 50).alias("lat"), F.lit(0.0).alias("lon"))
    for kind in ("gauss", "uniform", "exponential", "mixed"):
        assert X.noisy_surface(pts, kind, 0.1, 1, F.col("id")).where("v IS NULL").count() == 0


def test_brackets(spark):
    counts = spark.createDataFrame([("z", i, n) for i, n in enumerate([10, 10, 20, 0, 5])], "zone string, b int, c int")
    assert X.bracket_median(counts.where("b < 3"), "zone", "b", "c", [0, 100, 200, 400]).first().median == 200
    merged = X.merged_brackets(counts, ["zone"], "b", "c", {0: 0, 1: 0, 2: 1, 3: 1})
    assert {r.b: r.c for r in merged.collect()} == {0: 20, 1: 20, 2: 5}
    assert spark.range(1).select(X.patched_counts(F.lit(3)), X.percent(F.lit(1), F.lit(0)), X.percent(F.lit(1), F.lit(4))).first()[:] == (2, None, 25)


def test_matrices(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "r int, c int, v double")
    assert {(r.r, r.c): r.v for r in X.matrix_product(m, m).collect()} == {(0, 0): 7, (0, 1): 10, (1, 0): 15, (1, 1): 22}
    assert {r.v for r in X.matrices(m, m, "sub", ["r", "c"]).collect()} == {0}
    assert X.not_rectangular(m.where("r = 0").union(spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0)], m.schema))).first()[:] == (1, 1)


def test_choices_and_cars(spark):
    s = spark.createDataFrame([(1, "a", 2.0, True), (1, "b", 1.0, False), (2, "a", 1.0, True), (2, "b", 3.0, False)], "who int, opt string, score double, chosen boolean")
    assert X.reproduced_choices(s, "who", "opt", "score", "chosen").first()[:] == (1, 2)
    assert 0 < spark.range(1).select(X.ownership(F.lit(0.5), [-1.0, 1.0])).first()[0] < 2


def test_sectors_and_area(spark, tmp_path):
    (tmp_path / "s").write_text("sector0 1 2 3 4\nother 5\n")
    assert X.sectors_of(settings(spark, str(tmp_path / "s"))).first()[:] == (0, 1, 2, 3, 4)
    ring = spark.createDataFrame([("t", [(0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (0.0, 0.0)])], "name string, ring array<struct<lat: double, lon: double>>")
    assert X.sampled_ring_area(ring, 4000, 1).first().area == pytest.approx(2, abs=0.15)


def test_evolved_tree_beats_nothing(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    _, error = X.evolved(rows, ["x"], "y", 12, 3, 4)
    assert error <= rows.agg(F.avg(F.col("y") * F.col("y"))).first()[0]


def test_steps_city_and_systems(spark):
    assert X.stepped(spark.createDataFrame([(5, 5, "NW")], "lati int, loni int, d string"), F.col("d")).first()[:2] == (6, 4)
    d = spark.createDataFrame([(0.0, 0.0), (9.0, 9.0)], "lat double, lon double")
    assert [r.to_centre for r in X.city(d, (-1, 1, -1, 1), (0.0, 0.0)).collect()] == [0]
    s = spark.createDataFrame([(1, [[2.0, 0.0], [0.0, 4.0]], [2.0, 2.0]), (2, [[1.0, 1.0], [1.0, 1.0]], [1.0, 2.0])], "i int, a array<array<double>>, b array<double>")
    assert {r.i: r.x for r in X.solved(s, "i").collect()} == {1: [1.0, 0.5], 2: None}
    e = spark.createDataFrame([(1.0, math.e), (1.0, 1.0)], "y double, p double")
    assert X.log_error(e, "y", "p").first()[0] == pytest.approx(math.sqrt(0.5))
    h = spark.createDataFrame([("z", 10.0, 2), ("z", 20.0, 3)], "zone string, v double, people int")
    assert X.household_statistics(h, "zone", "v", "people").first()[:] == ("z", 30, 15, 6)


def test_more_readers_and_writers(spark, tmp_path):
    from lithos.operators.grid import Grid
    from lithos.sources import raster, sinks, text

    (tmp_path / "m").write_text("1.5 2 misfit 0.25\n7\n")
    assert text.models_by_width(spark, str(tmp_path / "m"), 2).first()[:] == ([1.5, 2.0], 0.25)
    rows = text.numbered(spark, str(tmp_path / "m"))
    assert text.first_lines(rows, F.substring("value", 1, 1)).where("key = '7'").first().line == 1
    assert text.complete_records(rows, 0, "misfit").count() == 0
    px = spark.createDataFrame([(0, 0, 255, 0, 0), (0, 1, 0, 0, 0)], "lati int, loni int, r int, g int, b int")
    assert [r.value for r in raster.any_rule(px, [(200, 255, 0, 9, 0, 9)]).orderBy("loni").collect()] == [1, 0]
    assert [r.value for r in raster.classified_pixels(px, [(4, 0, 255, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 0)]).collect()] == [4, 4]
    at = raster.pixel_places(spark.createDataFrame([(0, 0)], "x int, y int"), 0.0, 0.0, 1.0, 2.0, 2, 1).first()
    assert (at.lat, at.lon) == (0.5, 0.5)
    grid = Grid(0.0, 0.0, 2.0, 1.0, 2, 1)
    pmf = spark.createDataFrame([("s", 0, 1, 0, 1.0)], "sid string, t int, lati int, loni int, p double")
    assert [r.value for r in sinks.probability_lines(pmf, grid).orderBy("line").collect()] == ["1.0", "0.0"]
    assert "0.5,1.5,0" in sinks.likely_track(pmf, grid).first().value
    q = sinks.quintile_report(spark.range(10).select(F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w")), {"all": "v"}, "w").first()
    assert q.mean == 4.5 and (q.q1, q.q5) == (0.5, 8.5)
    out = sinks.Outputs()
    out.put("a", px)
    with pytest.raises(ValueError):
        out.put("a", px)


def test_layered_graph(spark):
    from lithos.operators import graph as N

    walk = spark.createDataFrame([(i, i + 1, 10.0) for i in range(4)], "src int, dst int, w double")
    routes = spark.createDataFrame([("r", 1, 3, 2.0)], "route string, src int, dst int, w double")
    paths = N.shortest_paths(N.layered(walk, routes, 1.0), spark.createDataFrame([("before:0",)], "o string"))
    assert paths.where("node = 'after:4'").first().dist == 23
