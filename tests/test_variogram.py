import math

import numpy as np
import pytest

from lithos.operators import interpolate as I


def test_anisotropy_is_found(spark):
    """Waves that change slowly along an axis 30 degrees north of east and fast across it."""
    r = np.random.default_rng(4)
    x, y = r.uniform(0, 0.6, 500), r.uniform(0, 0.6, 500)
    turn = math.radians(30)
    across = y * math.cos(turn) - x * math.sin(turn)
    value = np.sin(across * 2 * math.pi / 0.2)
    sites = spark.createDataFrame([(i, float(b), float(a), float(v)) for i, (a, b, v) in enumerate(zip(x, y, value))], "site int, lat double, lon double, v double")
    short, sill, ratio = I.fit_anisotropic(sites, "site", "v", 20000, 30)
    assert sill > 0 and ratio >= 2.5 and short <= 8000
    bins = {(b.axis, b.lag): b for b in I.directional_bins(sites, "site", "v", 20000, 30).collect()}
    assert bins[1, 7].g > 3 * bins[0, 7].g
    # turned and scaled, both axes have one range
    even = I.rotated(sites, -30, 1 / ratio)
    _, _, again = I.fit_anisotropic(even, "site", "v", 20000, 0)
    assert again < ratio


def test_one_site(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "site int, lat double, lon double, v double")
    assert I.directional_bins(one, "site", "v", 1000, 0).collect() == []
    assert I.fit_anisotropic(one, "site", "v", 1000, 0) == (1000, 0.0, pytest.approx(1.0))


@pytest.mark.parametrize("twice", [False, True])
def test_bins_of_sites_that_share_places(spark, monkeypatch, twice):
    """Counts, distances and semivariances as of all pairs, without making them, unless an id stands twice."""
    r = np.random.default_rng(6)
    places = [(float(a), float(b)) for a, b in r.uniform(0, 0.2, (9, 2))]
    rows = [(i, *places[i * i % 9], float(r.uniform(0, 100)) if i % 5 else None) for i in range(200)] + [(None, *places[0], 1.0), (500, None, 0.1, 1.0)]
    rows += [(3, *places[0], 7.0)] if twice else []
    sites = spark.createDataFrame(rows, "site int, lat double, lon double, v double")
    if not twice:
        monkeypatch.setattr(I, "placed_pairs", None)
    found = {(x.axis, x.lag): x for x in I.directional_bins(sites, "site", "v", 15000, 30, 5).collect()}
    bins, turn, narrow = {}, math.radians(30), math.tan(math.radians(22.5))
    ok = [x for x in rows if x[0] is not None and x[1] is not None]
    for a in ok:
        for b in ok:
            u, v = math.radians(a[1]), math.radians(b[1])
            h = math.sin((u - v) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
            d = 2 * 6372795 * math.asin(math.sqrt(h))
            if a[0] >= b[0] or d > 15000:
                continue
            north, east = b[1] - a[1], (b[2] - a[2]) * math.cos((u + v) / 2)
            along, across = east * math.cos(turn) + north * math.sin(turn), north * math.cos(turn) - east * math.sin(turn)
            axis = 0 if abs(across) <= abs(along) * narrow else 1 if abs(along) <= abs(across) * narrow else None
            if axis is not None:
                bins.setdefault((axis, int(d / 3000)), []).append((d, None if None in (a[3], b[3]) else (a[3] - b[3]) ** 2 / 2))
    assert set(found) == set(bins)
    for k, pairs in bins.items():
        g = [x for _, x in pairs if x is not None]
        assert found[k].n == len(pairs) and found[k].d == pytest.approx(sum(d for d, _ in pairs) / len(pairs)) and found[k].g == pytest.approx(sum(g) / len(g))
