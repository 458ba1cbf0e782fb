"""Operators on small literal tables with hand-computed answers, and properties of random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import bins as B
from lithos.operators import density as D
from lithos.operators import forest as R
from lithos.operators import graph as N
from lithos.operators import grid as G
from lithos.operators import interpolate as I
from lithos.operators import joins as J
from lithos.operators import order as O
from lithos.operators import stats as S
from lithos.operators import timeseries as T
from lithos.operators import tracking as K
from lithos.operators import transport as P


def values(spark, xs, name="v"):
    return spark.createDataFrame([(float(x),) for x in xs], f"{name} double")


def test_join_last_wins(spark):
    left = spark.createDataFrame([("a ", 1), ("b", 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 2)], "k string, q string, n int")
    out = {r.x: r.q for r in J.lookup(left, right, "k", ["q"], ["n"], J.JOIN_FAILED).collect()}
    assert out == {1: "y", 2: "z", 3: J.JOIN_FAILED}


def test_histogram_and_bins(spark):
    rows = S.histogram(values(spark, range(5)), "v", 2).orderBy("bin").collect()
    assert [(r.edge, r.cnt) for r in rows] == [(0, 2), (2, 3)]
    assert [r.bin for r in B.equal_count_bins(values(spark, range(1, 8)), "v", 3).orderBy("v").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert S.tail_bounds(values(spark, range(1, 17)), "v", 0.75).first()[:] == (3, 14)
    df = values(spark, [1, 2, 3, 4])
    assert df.agg(S.upper_median("v"), F.median("v")).first()[:] == (3, 2.5)
    assert S.histogram(values(spark, [7, 7]), "v", 3).agg(F.sum("cnt")).first()[0] == 2


def test_grouped_quantile(spark):
    counts = spark.createDataFrame([(0, 10), (1, 10), (2, 20)], "b int, c int")
    assert S.grouped_quantile(counts, None, "b", "c", 0.5).first().position == 2.0


def test_shares_and_entropy(spark):
    rows = spark.createDataFrame([("a", 96.0), ("a", 4.0), ("b", 60.0), ("b", 37.0), ("b", 3.0)], "g string, n double")
    kept = S.dominant_shares(S.shares(rows, "n", "g"), "g", "share").orderBy("g", "n").collect()
    assert [round(r.new_share, 9) for r in kept] == [1.0, round(37 / 97, 9), round(60 / 97, 9)]
    assert S.entropy(spark.createDataFrame([("x",), ("y",)], "c string"), "c").first().entropy == 1.0
    assert [r.share for r in S.shares(values(spark, [0, 0]), "v").collect()] == [0.5, 0.5]


def test_sigma_clip_and_fits(spark):
    mean, sd, lo, hi = S.sigma_clip(values(spark, [1] * 20 + [2] * 20 + [1000]), "v", 3)
    assert (mean, lo, hi) == (1.5, 1, 2)
    xy = spark.createDataFrame([(float(x), 2.0 * x * x - 3 * x + 1) for x in range(10)], "x double, y double")
    assert S.fit_polynomial(xy, "x", "y", 2) == pytest.approx([2, -3, 1])
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    assert S.fit(line, "x", "y").first()[:] == pytest.approx((2, 1, 1))


def test_order(spark):
    df = spark.range(101).select(F.pmod(F.xxhash64("id"), F.lit(10)).alias("g"), "id", F.lit(1.5).alias("v"))
    ranked = O.prefix(df, ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 102))
    by_group = O.prefix(df, ["id"], by="g")
    assert by_group.groupBy("g").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).where("m <> n").count() == 0
    run = O.prefix(df, ["id"], "v", out="s").orderBy(F.desc("id")).first()
    assert run.s == 151.5
    folds = O.folds(df, 4, 1, "id")
    assert folds.where("test").count() == 101 and folds.count() == 404
    bag = O.bootstrap(df.select("id"), 5, "id")
    assert bag.agg(F.sum("times")).first()[0] == 101 and 0 < bag.where("times = 0").count() < 101
    assert [r.id for r in O.sample(df, 7, 3, "id").collect()] == [r.id for r in O.sample(df, 7, 3, "id").collect()]
    assert O.prefix(df.limit(0), ["id"]).collect() == []


def test_nearest_falls_back_to_wider_cells(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 100.0), (3, None, 1.0)], "id int, lat double, lon double")
    sites = spark.createDataFrame([(10, 0.0, 0.01), (11, -60.0, -100.0), (12, 0.0, -0.01)], "site int, lat double, lon double")
    found = {(r.id, r["rank"]): r.site for r in J.nearest(points, sites, 2).collect()}
    assert found[1, 1] == 10 and found[1, 2] == 12 and (2, 2) in found and (3, 1) not in found


@pytest.mark.parametrize("metric", ["haversine", "planar", "planar_squared"])
@pytest.mark.parametrize("few,crowd", [(64, None), (0, 6)])
def test_nearest_equals_brute_force(spark, metric, few, crowd):
    """A dense town, sites at one place, both sides of the date line, poles and far points."""
    rng, k = random.Random(5), 3
    town = [(rng.gauss(-33.8, 0.02), rng.gauss(151.2, 0.02)) for _ in range(25)]
    line = [(rng.uniform(-20, -10), rng.choice([179.9, -179.9, 179.2, -179.2])) for _ in range(8)]
    sites = [*town, *town[:3], *[town[0]] * 7, *line, (89.95, 10.0), (89.95, 11.0), (-89.0, -100.0), (50.0, 0.0)]
    points = [*[(rng.gauss(-33.8, 0.03), rng.gauss(151.2, 0.03)) for _ in range(20)], *line[:4], (89.97, 10.4), (-89.9, 90.0), (0.0, -30.0), (-15.0, 180.0), town[0]]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, lat double, lon double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)] + [(99, None, 0.0)], "site int, lat double, lon double")

    def dist(a, b):
        if metric != "haversine":
            flat = (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
            return flat if metric == "planar_squared" else math.sqrt(flat)
        u, v, w = math.radians(a[0]), math.radians(b[0]), math.radians(a[1] - b[1])
        return 2 * 6372795 * math.asin(math.sqrt(min(1, math.sin((u - v) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(w / 2) ** 2)))

    found = J.nearest(p, s, k, metric=metric, digits=6, few=few, crowd=crowd).collect()
    expected = {(i, n + 1): j for i, x in enumerate(points) for n, (_, j) in enumerate(sorted((round(dist(x, y), 6), j) for j, y in enumerate(sites))[:k])}
    assert {(r.id, r["rank"]): r.site for r in found} == expected and len(found) == len(expected)


def test_idw(spark):
    d = math.degrees(1000 / 6372795)
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    sites = spark.createDataFrame([(1, d, 0.0, 0.0), (2, 2 * d, 0.0, 10.0)], "site int, lat double, lon double, v double")
    assert J.inverse_distance(points, sites, "v").first().idw == pytest.approx(2.0)


def test_gap_pairs(spark):
    rows = spark.createDataFrame([("s", t) for t in (0, 20, 50, 400)], "source string, t long")
    assert [r[:] for r in J.gap_pairs(rows, "source", F.col("t")).collect()] == [("s", 0, 50)]


def test_grid(spark):
    grid = G.Grid(0.0, 0.0, 2.0, 2.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 0.0)], "lati int, loni int, value double")
    assert G.shrunk(cells, 2, "binary").first().value == 1
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.1, 0.1), (3, 5.0, 5.0)], "id int, lat double, lon double")
    assert {r.id: r.value for r in G.sample(points, cells, grid).collect()} == {1: 0.0, 2: 1.0, 3: None}
    assert {r.value for r in G.boundary(cells).collect()} == {1.0}
    zonal = G.zonal(cells, cells)
    assert zonal.agg(F.sum("total")).first()[0] == cells.agg(F.sum("value")).first()[0]
    assert G.quadtree(cells, 1).count() == 4


def test_graph(spark):
    edges = spark.createDataFrame([(a, b, w) for x, y, w in ((1, 2, 1.0), (2, 3, 1.0), (1, 3, 3.0), (3, 4, 2.0)) for a, b in ((x, y), (y, x))], "src int, dst int, w double")
    paths = N.shortest_paths(edges, spark.createDataFrame([(1,)], "o int"))
    assert {r.node: r.dist for r in paths.collect()} == {1: 0, 2: 1, 3: 2, 4: 4}
    assert [r.node for r in N.path_nodes(paths, 1, 4).orderBy("step").collect()] == [1, 2, 3, 4]
    trips = spark.createDataFrame([(1, 4, 5.0)], "origin int, dest int, trips double")
    assert {(r.src, r.dst): r.trips for r in N.edge_loads(paths, trips, edges).collect()} == {(1, 2): 5, (2, 3): 5, (3, 4): 5}


def test_most_likely_path(spark):
    steps = spark.createDataFrame([("a", "a", -0.1), ("a", "b", -1.0), ("b", "b", -0.1), ("b", "a", -1.0)], "src string, dst string, logp double")
    seen = spark.createDataFrame([(0, "a", -0.1), (0, "b", -2.0), (1, "a", -1.0), (1, "b", -0.9), (2, "a", -0.1), (2, "b", -3.0)], "t int, state string, logp double")
    assert [r.state for r in N.most_likely_path(steps, seen).orderBy("t").collect()] == ["a", "a", "a"]


def test_series(spark):
    rows = spark.createDataFrame([("u", 1, 1.0), ("u", 2, 2.0), ("u", 3, 3.0)], "k string, i int, v double")
    assert T.smoothed_last(rows, "k", ["i"], "v", 0.5).first().ema == 2.25
    closes = spark.createDataFrame([("u", 1, 1.0), ("u", 2, 2.0), ("u", 3, 4.0)], "k string, i int, v double")
    vol = T.with_volatility(closes, "k", "i", "v", 3).orderBy(F.desc("i")).first().vol
    assert vol == pytest.approx(math.sqrt(0.5))


def test_transport(spark):
    costs = spark.createDataFrame([("z", 0, 1.0), ("z", 1, 1.0)], "zone string, mode int, cost double")
    assert [r.p for r in P.logit_split(costs, "zone", "cost", 1.0).collect()] == [0.5, 0.5]
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "r int, c int, v double")
    rows, cols = (spark.createDataFrame([(0, 10.0), (1, 20.0)], f"{k} int, total double") for k in "rc")
    done = P.balance_table(cells, rows, cols)
    assert [round(r[0], 3) for r in done.groupBy("r").agg(F.sum("v").alias("s"), F.first("r").alias("k")).orderBy("r").select("s").collect()] == [10, 20]
    stock = spark.createDataFrame([("a", 0, 6.0), ("b", 0, 10.0)], "zone string, dwelling int, free double")
    desire = spark.createDataFrame([(b, z, 0, 1.0) for b in range(2) for z in "ab"], "band int, zone string, dwelling int, weight double")
    people = spark.range(12).select(F.col("id").alias("hh"), F.col("id").cast("double").alias("income"))
    assert P.allocated(people, stock, desire, 1, bands=2).agg(F.sum("housed")).first()[0] == pytest.approx(12)


def test_tracking(spark):
    pmf = spark.createDataFrame([("s", 0, 0, 0, 2.0), ("s", 0, 0, 1, 2.0)], "sid string, t int, lati int, loni int, p double")
    assert [r.p for r in K.normalised(pmf).collect()] == [0.5, 0.5]
    assert K.uninformative(pmf).count() == 1
    assert K.product(pmf, pmf).agg(F.sum("p")).first()[0] == 1


def test_density(spark):
    models = spark.createDataFrame([([0.0, 1.0],), ([0.5, 1.0],), ([1.0, 0.2],)], "params array<double>")
    hist = D.marginals(models, [(0, 1), (0, 1)], 2)
    assert [r.cnt for r in hist.where("dim = 0").orderBy("bin").collect()] == [1, 2]
    assert D.rescaled(hist, 0, 0.0, 0.5, 1).first().cnt == 1
    assert {r.dim: r.mode for r in D.modes(hist).collect()} == {0: 0.75, 1: 0.75}


def test_kriging_beats_the_mean(spark):
    sites = spark.createDataFrame([(i, (i % 7) * 0.01, (i // 7) * 0.01, math.sin((i % 7) / 3) + (i // 7) / 5) for i in range(49)], "site int, lat double, lon double, v double")
    rng, sill = I.fit_variogram(sites, "site", "v", 6000)
    mse = {r.method: r.mse for r in I.compare(sites, "v", 3, kriging=(8, rng, sill)).collect()}
    assert mse["kriging"] < mse["mean"] and mse["inverse_distance"] < mse["mean"]


def test_forest(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10) * 2.0).alias("y"))
    oob = R.out_of_bag(df, ["x"], "y", "id", trees=9, depth=4)
    bounds = R.out_of_bag_bounds(oob, "id")
    assert bounds.where("trees >= 8 AND lo_75 IS NULL").count() == 0 and bounds.where("lo_90 IS NOT NULL").count() == 0
    assert R.split_error(df, "x", "y", 5.0).first().error == pytest.approx(60 * 8)


def test_kmeans(spark):
    df = values(spark, [0, 0.1, 0.2, 10, 10.1, 10.2])
    out, centres = B.kmeans_1d(df, "v", 2)
    assert [r.cluster for r in out.orderBy("v").collect()] == [0, 0, 0, 1, 1, 1] and centres == pytest.approx([0.1, 10.1])


def town(spark, points: int = 600, sites: int = 300):
    """Points and sites that share a few places, some of them with both; some values, and one place of each, are null."""
    rng = random.Random(8)
    places = [(-33.8 + i / 50, 151.0 + j / 40) for i in range(4) for j in range(4)]
    p = [(i, *rng.choice(places[:12]), float(rng.randrange(100)) if i % 7 else None) for i in range(points)] + [(points, None, 151.0, 1.0)]
    s = [(i, *rng.choice(places[4:]), rng.random() * 100 if i % 9 else None) for i in range(sites)] + [(sites, -33.8, None, 1.0)]
    return p, s, spark.createDataFrame(p, "id int, lat double, lon double, value double"), spark.createDataFrame(s, "site int, lat double, lon double, v double")


def metres(a, b):
    u, v, w = math.radians(a[1]), math.radians(b[1]), math.radians(a[2] - b[2])
    return 2 * 6372795 * math.asin(math.sqrt(min(1, math.sin((u - v) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(w / 2) ** 2)))


def test_idw_measures_places(spark, monkeypatch):
    """Points and sites at a few places: the same sums as by pairs, from a pair for each two places."""
    p, s, points, sites = town(spark)
    seen, blocks = [], J.in_blocks
    monkeypatch.setattr(J, "in_blocks", lambda a, b: seen.append((a.count(), b.count())) or blocks(a, b))
    found = {r.id: r.idw for r in J.inverse_distance(points, sites, "v").collect()}
    assert seen == [(13, 13)] and len(found) == len(p)
    for x in p[:40]:
        w = [(1 / (metres(x, y) / 1000) ** 2, y[3]) for y in s[:-1] if metres(x, y) > 0]
        assert found[x[0]] == pytest.approx(sum(a * v for a, v in w if v is not None) / sum(a for a, _ in w), rel=1e-6)


def test_totals_within_measure_places(spark, monkeypatch):
    p, s, points, sites = town(spark)
    seen, pairs = [], J.within
    monkeypatch.setattr(J, "within", lambda a, b, far: seen.append((a.count(), b.count())) or pairs(a, b, far))
    found = {r.site: r for r in J.totals_within(points, sites, 3000, "value").collect()}
    assert seen == [(13, 13)]
    expected = {y[0]: [x[3] for x in p[:-1] if metres(x, y) <= 3000] for y in s[:-1]}
    assert set(found) == {k for k, v in expected.items() if v}
    for k, r in found.items():
        assert r.n == len(expected[k]) and r.total == sum(v for v in expected[k] if v is not None)


class Counting(J.Scratch):
    """Tables that tell how many rows the largest of them had."""

    most = 0

    def save(self, df, codec=None):
        out = super().save(df, codec)
        Counting.most = max(Counting.most, out.count())
        return out


def test_nearest_looks_places_up_once(spark, monkeypatch):
    """Points and sites at a few places: no table on the way holds a row for each point."""
    p, s, points, sites = town(spark)
    monkeypatch.setattr(J, "Scratch", Counting)
    monkeypatch.setattr(Counting, "most", 0)
    found = {(r.id, r["rank"]): r.site for r in J.nearest(points, sites, 5).collect()}
    assert found == {(x[0], n + 1): j for x in p[:-1] for n, (_, j) in enumerate(sorted((round(metres(x, y), 3), y[0]) for y in s[:-1])[:5])}
    assert Counting.most <= 60  # five for each of twelve places


def test_two_nearest_blend_of_places(spark, monkeypatch):
    """One blend a place; points without a place have none."""
    p, s, points, sites = town(spark)
    asked, near = [], J.nearest
    monkeypatch.setattr(J, "nearest", lambda a, *more: asked.append(a.count()) or near(a, *more))
    found = {r.id: r.blend for r in J.two_nearest_blend(points, sites, "v").collect()}
    assert asked == [12] and set(found) == {x[0] for x in p[:-1]}
    for x in p[:40]:
        two = sorted((round(metres(x, y), 3), y[0], metres(x, y), y[3]) for y in s[:-1])[:2]
        told = [(1 / max(d, 1e-9), v) for _, _, d, v in two]
        top = [w * v for w, v in told if v is not None]
        assert found[x[0]] == (pytest.approx(sum(top) / sum(w for w, _ in told), rel=1e-6) if top else None)


def test_semivariance_of_pairs_at_few_places(spark, monkeypatch):
    """Every pair once, from one distance for each two places; parts of a place meet each other, equal ids and rows without an id
    or a place make no pair."""
    rng = random.Random(2)
    _, s, _, _ = town(spark)
    s = [*s, (7, *s[11][1:3], 5.0), (None, *s[3][1:3], 5.0)]
    rng.shuffle(s)
    sites = spark.createDataFrame(s, "site int, lat double, lon double, v double")
    seen, pairs = [], J.within
    monkeypatch.setattr(J, "TOGETHER", 10)
    monkeypatch.setattr(J, "within", lambda a, b, far: seen.append((a.count(), a.rdd.getNumPartitions())) or pairs(a, b, far))
    found = sorted((r.a, r.b, round(r.dist, 3), r.semivariance) for r in J.pair_semivariance(sites, "site", "v", 3000).collect())
    assert seen[0][0] < 60 and seen[0][1] > 20  # three parts or so for each place, dealt to many tasks
    ok = [x for x in s if None not in x[:3]]
    expected = [(x[0], y[0], round(metres(x, y), 3), None if None in (x[3], y[3]) else (x[3] - y[3]) ** 2 / 2) for x in ok for y in ok if x[0] < y[0] and metres(x, y) <= 3000]
    assert [f[:3] for f in found] == [e[:3] for e in sorted(expected, key=lambda e: e[:3])]
    total = lambda rows: sum(r[3] for r in rows if r[3] is not None)
    assert total(found) == pytest.approx(total(expected)) and sum(r[3] is None for r in found) == sum(r[3] is None for r in expected)
