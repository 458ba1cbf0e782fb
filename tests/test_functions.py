"""Scalar functions and geometry on small, hand-checked values."""

import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithos.functions import expression as E
from lithos.functions import geo, maths, text


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cols: spark.range(1).select(*cols).first()


SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def ring(points):
    return F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in points))


def test_square(one):
    r = ring(SQUARE)
    row = one(geo.ring_area(r), geo.ring_centroid(r), geo.point_in_ring(F.lit(0.5), F.lit(0.5), r), geo.point_in_ring(F.lit(2.0), F.lit(2.0), r), geo.is_concave(r), geo.signed_area(geo.clockwise(r)))
    assert row[0] == 1 and tuple(row[1]) == (0.5, 0.5) and row[2] and not row[3] and not row[4] and row[5] == -1


def test_distances(one):
    assert one(geo.haversine(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))[0] == pytest.approx(math.radians(1) * 6372795)
    assert one(geo.haversine(*map(F.lit, (10.0, 20.0, 10.0, 20.0))))[0] == 0
    assert one(geo.bearing_class(*map(F.lit, (0.0, 0.0, 0.0, -1.0))))[0] == "W"
    assert one(geo.vector_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))))[0] == 5
    assert one(geo.wrap_lat(F.lit(95.0)), geo.wrap_lon(F.lit(190.0)))[:] == (85.0, -170.0)


def test_maths(one):
    assert one(maths.safe_divide(F.lit(1.0), F.lit(0.0)))[0] == maths.LARGEST
    assert one(maths.whole_power(F.lit(2.0), F.lit(2.5)))[0] == 8
    assert one(maths.gaussian_tail(F.lit(1.96)))[0] == pytest.approx(0.0249979, abs=1e-6)
    assert one(maths.binomial_log_pmf(F.lit(3), F.lit(10), F.lit(0.5)))[0] == pytest.approx(math.log(120 / 1024))
    assert one(maths.log_factorial(F.lit(20)))[0] == pytest.approx(math.lgamma(21), abs=1e-9)
    assert sum(one(maths.ordinal_shares(F.lit(0.3), [-1.0, 0.5, 2.0]))[0]) == pytest.approx(1)
    assert one(maths.java_round(F.lit(-2.5)))[0] == -2
    assert tuple(one(maths.gradient_colour(F.lit(5.0), 0, 10, [(0, 0, 0), (255, 0, 0)]))[0]) == (128, 0, 0)


def test_text(one):
    assert one(text.tokens(F.lit("  a b\t c ")))[0] == ["a", "b", "c"]
    assert one(text.whole_number(F.lit(" 1,234 ")), text.whole_number(F.lit("x")))[:] == (1234, None)
    assert one(text.parse_array(F.lit("[1, 2.5,3]")))[0] == [1, 2.5, 3]
    assert tuple(one(text.band_label(F.lit("$1,000-$1,999")))[0]) == (1000, 1999)
    assert one(text.unquoted_commas(F.lit('a,"b,c",d')))[0] == "a,b c,d"
    assert one(text.day_month_year(F.lit(5), F.lit("january"), F.lit("04")))[0] == datetime.date(2004, 1, 5)
    assert one(text.bits_to_byte(F.array(F.lit(True), F.lit(False), F.lit(True))))[0] == 0b10100000
    assert one(text.truncated(F.lit(123.456), 5), text.truncated(F.lit(123456.7), 3, "?"))[:] == ("123.4", "?")


def test_expression_trees(one):
    import random

    rng = random.Random(4)
    a, b = E.random_tree(["id"], 5, rng), E.random_tree(["id"], 5, rng)
    assert one(E.column(("if", 1, 2, 3, ("sub", 5, ("sqrt", -4)))))[0] == 3
    for t in (a, b, E.crossover(a, b, rng), E.perturbed(a, rng)):
        assert one(E.column(t))[0] is not None
    with pytest.raises(ValueError):
        E.column(("add", 1))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-80, 80), st.floats(-170, 170)), min_size=3, max_size=3))
def test_triangle_inequality(spark, points):
    (a, b, c) = [tuple(map(F.lit, p)) for p in points]
    ab, bc, ac = spark.range(1).select(geo.haversine(*a, *b), geo.haversine(*b, *c), geo.haversine(*a, *c)).first()
    assert ac <= ab + bc + 1e-3


def test_rounding_and_division_as_sql_does(spark):
    """Near halves, whose shortest decimals are halves, and zeros of either sign, held against DuckDB."""
    import duckdb

    from lithos.plans.views import rounded

    pairs = [(66.77, 32.0), (33.38, 16.0), (-66.77, 32.0), (12.0, 0.0), (-12.0, 0.0), (0.0, 0.0), (12.0, -0.0), (None, 0.0), (1.0, None), (1e303, 1.0), (0.285, 1.0), (1.005, 1.0)]
    pairs += [(k / 100, d) for k in range(1, 20000, 37) for d in (16.0, 32.0, 64.0, 3.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").select("i", maths.ieee_divide(F.col("a"), F.col("b")).alias("x"))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t(i INTEGER, a DOUBLE, b DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, *p) for i, p in enumerate(pairs)])
    for digits in (2, 6):
        expected = duck.execute(f"SELECT i, round(a / b, {digits}) FROM t ORDER BY i").fetchall()
        assert [repr(tuple(r)) for r in rounded(df, digits).orderBy("i").collect()] == [repr(r) for r in expected]


def test_earlier_close_of_zeros(spark):
    from lithos.operators import timeseries as T

    rows = [(1, 66.77), (2, 5.0), (3, 32.0), (4, 0.0), (5, 1.0), (6, 0.0), (7, 0.0), (8, 0.0)]
    w = T.chain(None, ["t"])
    told = spark.createDataFrame(rows, "t int, v double").select("t", T.earlier_close(F.col("v"), w, 2).alias("x")).orderBy("t").collect()
    assert repr([r.x for r in told]) == repr([None, None, 66.77 / 32, float("inf"), 32.0, float("nan"), float("inf"), float("nan")])


ZEROS = [(1, 1, 2.0), (1, 2, 0.0), (1, 3, 5.0), (1, 4, 6.0), (1, 5, 3.0), (1, 6, 4.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 1.0), (3, 1, 1.0), (3, 2, 2.0), (3, 3, 3.0), (4, 1, 0.0), (4, 2, 7.0), (5, 1, None), (5, 2, 1.0)]


def zeros(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("CREATE TABLE t(k INTEGER, t INTEGER, v DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?)", ZEROS)
    duck.execute("CREATE VIEW d AS SELECT k, t, (v - lag(v) OVER w) / lag(v) OVER w AS pct FROM t WINDOW w AS (PARTITION BY k ORDER BY t)")
    return spark.createDataFrame(ZEROS, "k int, t int, v double"), lambda sql: sorted(repr(r) for r in duck.execute(sql).fetchall())


def test_pct_volatility_of_zeros(spark):
    from lithos.operators import timeseries as T
    from lithos.plans.views import rounded

    rows, sql = zeros(spark)
    told = rounded(T.pct_volatility(rows, "k", "t", "v"))
    assert sorted(repr(tuple(r)) for r in told.collect()) == sql("SELECT k, round(stddev_samp(pct), 6) FROM d GROUP BY k")


def test_volatility_of_zeros(spark):
    from lithos.operators import timeseries as T
    from lithos.plans.views import rounded

    rows, sql = zeros(spark)
    told = rounded(T.with_volatility(rows, "k", "t", "v", 3).select("k", "t", "mean_pct", "pct_vol"))
    frame = "(PARTITION BY d.k ORDER BY d.t ROWS 2 PRECEDING)"
    assert sorted(repr(tuple(r)) for r in told.collect()) == sql(f"SELECT k, t, round(avg(pct) OVER {frame}, 6), round(stddev_samp(pct) OVER {frame}, 6) FROM d")
