"""Spatial prediction: kriging, and the comparison of predictors by folds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.maths import spherical_variogram
from lithos.operators.joins import inverse_distance, nearest, pair_semivariance, part, placed_pairs, two_nearest_blend, within
from lithos.operators.order import folds
from lithos.scratch import Scratch


def fit_variogram(sites: DataFrame, ident: str, value: str, metres: float, lags: int = 40, ranges: int = 20, sills: int = 41) -> tuple[float, float]:
    """Range and sill of the spherical model that misses the binned semivariances of pairs up to `metres` apart least.

    Pairs are binned by distance first, so the search over ranges (up to `metres`) and sills (half to one and a half times
    the mean semivariance) weighs `lags` means by their pairs instead of the pairs themselves.
    """
    pairs = pair_semivariance(sites, ident, value, metres)
    width = metres / lags
    bins = pairs.groupBy(F.floor(F.col("dist") / width).alias("lag")).agg(F.avg("dist").alias("d"), F.avg("semivariance").alias("g"), F.count(F.lit(1)).alias("n"))
    return fitted(bins, metres, ranges, sills)


def fitted(bins: DataFrame, metres: float, ranges: int, sills: int, sill: float | None = None) -> tuple[float, float]:
    """Range and sill of the spherical model that misses the bins (d, g, n) least; with `sill` the range alone is sought."""
    mean = bins.agg(F.try_divide(F.sum(F.col("g") * F.col("n")), F.sum("n"))).first()[0]
    if not mean:
        return metres, mean or 0.0
    span = F.lit(float(sill)) if sill is not None else mean * (0.5 + F.pmod("id", F.lit(sills)) / (sills - 1))
    grid = bins.sparkSession.range(ranges * sills).select(((F.floor(F.col("id") / sills) + 1) * metres / ranges).alias("r"), span.alias("s")).distinct()
    miss = F.col("g") - spherical_variogram(F.col("d"), F.col("r"), F.col("s"))
    best = bins.crossJoin(F.broadcast(grid)).groupBy("r", "s").agg(F.sum(miss * miss * F.col("n")).alias("e")).orderBy("e", "r", "s").first()
    return best.r, best.s


def directional_bins(sites: DataFrame, ident: str, value: str, metres: float, degrees: float, lags: int = 20, spread: float = 22.5) -> DataFrame:
    """axis, lag, d, g, n: mean distance and semivariance of the pairs of sites up to `metres` apart whose way lies within
    `spread` degrees of an axis, in `lags` bins of distance. Axis 0 leads `degrees` from east to north, axis 1 across it."""
    pairs = pair_sums(sites, ident, value, metres)
    north, east = F.col("lat_b") - F.col("lat_a"), (F.col("lon_b") - F.col("lon_a")) * F.cos(F.radians((F.col("lat_a") + F.col("lat_b")) / 2))
    turn = math.radians(degrees)
    along, across = east * math.cos(turn) + north * math.sin(turn), north * math.cos(turn) - east * math.sin(turn)
    narrow = math.tan(math.radians(spread))
    axis = F.when(F.abs(across) <= F.abs(along) * narrow, 0).when(F.abs(along) <= F.abs(across) * narrow, 1)
    lag = F.floor(F.col("dist") / (metres / lags)).cast("int")
    means = F.try_divide(F.sum(F.col("dist") * F.col("n")), F.sum("n")).alias("d"), F.try_divide(F.sum("g"), F.sum("known")).alias("g")
    return pairs.withColumn("axis", axis).where("axis IS NOT NULL").groupBy("axis", lag.alias("lag")).agg(*means, F.sum("n").alias("n"))


def pair_sums(sites: DataFrame, ident: str, value: str, metres: float) -> DataFrame:
    """lat_a, lon_a, lat_b, lon_b, dist, n, known, g: for each two places at most `metres` apart how many pairs of sites with
    different ids there are, how many of them have both values, and the sum of these pairs' semivariances.

    Of a place's sites their number, mean and squared deviations say all that is asked, so no pair is made, unless an id stands
    at more than one row, or a value is infinite: then each pair is a row with n = 1."""
    ends = lambda k: (F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
    odd = sites.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(value).cast("double"))).alias("most"))
    if not odd.where((F.col(ident).isNotNull() & (F.col("n") > 1)) | (F.col("most") == float("inf"))).isEmpty():
        pairs, n = placed_pairs(sites, ident, value, metres), F.lit(1).cast("long")
        known = F.when(F.col("semivariance").isNotNull(), n).alias("known")
        return pairs.select(*ends("a"), F.col("s_lat").alias("lat_b"), F.col("s_lon").alias("lon_b"), "dist", n.alias("n"), known, F.col("semivariance").alias("g"))
    v = F.col(value).cast("double")
    facts = F.count(F.lit(1)).alias("n"), F.count(v).alias("m"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("off")
    places = sites.where(F.col(ident).isNotNull()).groupBy("lat", "lon").agg(*facts).withColumn("k", F.monotonically_increasing_id())
    places = Scratch(sites.sparkSession, "places").save(places)
    near = within(places, places, metres).where("k <= s_k")
    same = F.col("k") == F.col("s_k")
    apart = F.col("mean") - F.col("s_mean")
    n = F.when(same, F.floor(F.col("n") * (F.col("n") - 1) / 2)).otherwise(F.col("n") * F.col("s_n"))
    known = F.when(same, F.floor(F.col("m") * (F.col("m") - 1) / 2)).otherwise(F.col("m") * F.col("s_m"))
    g = F.when(same, F.col("m") * F.col("off")).otherwise(F.col("s_m") * F.col("off") + F.col("m") * F.col("s_off") + F.col("m") * F.col("s_m") * apart * apart) / 2
    told = near.select(*ends("a"), F.col("s_lat").alias("lat_b"), F.col("s_lon").alias("lon_b"), "dist", n.alias("n"), known.alias("known"), g.alias("g"))
    return told.where("n > 0")


def fit_anisotropic(sites: DataFrame, ident: str, value: str, metres: float, degrees: float, lags: int = 20, ranges: int = 20, sills: int = 41) -> tuple[float, float, float]:
    """Range across the axis, sill, and how many times as long the range along it is. The sill is that of all pairs; a range is
    fitted for each axis. rotated() with the ratio makes the data fit one range."""
    bins = directional_bins(sites, ident, value, metres, degrees, lags).persist()
    whole = bins.groupBy("lag").agg(F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("d"), F.try_divide(F.sum(F.col("g") * F.col("n")), F.sum("n")).alias("g"), F.sum("n").alias("n"))
    _, sill = fitted(whole, metres, ranges, sills)
    along, across = (fitted(bins.where(F.col("axis") == k), metres, ranges, 1, sill)[0] for k in (0, 1))
    bins.unpersist()
    return across, sill, along / across


def krige(points: DataFrame, sites: DataFrame, value: str, k: int, rng: float, sill: float, point_id: str = "id", site_id: str = "site") -> DataFrame:
    """Ordinary kriging of each point from its k nearest sites with a spherical variogram: point_id, estimate, variance.
    Each point's system is of k + 1 equations; systems of one size are solved as one stack."""
    near = nearest(points, sites, k, point_id, site_id).join(sites.select(site_id, "lat", "lon", value), site_id)
    packed = near.groupBy(point_id).agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "lat", "lon", F.col(value).cast("double").alias("v")))).alias("near"))
    rows = packed.select(point_id, *(part("near", c).cast("array<double>").alias(c) for c in ("dist", "lat", "lon", "v")))

    def gamma(d):
        q = np.minimum(d / rng, 1.0) if rng else np.ones_like(d)
        return np.where(d <= 0, 0.0, sill / 2 * (3 * q - q**3))

    def solve(frames):
        import pandas as pd

        half = lambda x: np.sin(x / 2) ** 2
        for pdf in frames:
            out = [pd.DataFrame({point_id: pdf[point_id].iloc[:0], "estimate": [], "variance": []})]
            for n, some in pdf.groupby(pdf["dist"].map(len)):
                dist, lat, lon, v = (np.array(some[c].tolist(), dtype=float).reshape(-1, n) for c in ("dist", "lat", "lon", "v"))
                lat, lon = np.radians(lat), np.radians(lon)
                h = half(lat[:, :, None] - lat[:, None, :]) + np.cos(lat)[:, :, None] * np.cos(lat)[:, None, :] * half(lon[:, :, None] - lon[:, None, :])
                a, b = np.ones((len(some), n + 1, n + 1)), np.ones((len(some), n + 1))
                a[:, :n, :n], a[:, n, n], b[:, :n] = gamma(2 * 6372795.0 * np.arcsin(np.sqrt(np.minimum(1, h)))), 0.0, gamma(dist)
                w = np.einsum("bij,bj->bi", np.linalg.pinv(a), b)  # the least weights, where two sites share a place
                out.append(pd.DataFrame({point_id: some[point_id].to_numpy(), "estimate": (w[:, :n] * v).sum(axis=1), "variance": (w * b).sum(axis=1)}))
            yield pd.concat(out[1:] or out, ignore_index=True)

    return rows.mapInPandas(solve, f"{point_id} {dict(rows.dtypes)[point_id]}, estimate double, variance double")


def rotated(points: DataFrame, degrees: float, ratio: float) -> DataFrame:
    """Points with lat, lon turned and the second axis scaled, so that an isotropic model fits anisotropic data: for data whose
    range along an axis that leads `d` degrees from east to north is `k` times that across it, turn by -d and scale by 1 / k."""
    a = math.radians(degrees)
    y, x = F.col("lat"), F.col("lon")
    return points.withColumns({"lat": y * math.cos(a) - x * math.sin(a), "lon": (y * math.sin(a) + x * math.cos(a)) * ratio})


def compare(sites: DataFrame, value: str, k: int = 5, seed: int = 1, site_id: str = "site", kriging: tuple[int, float, float] | None = None) -> DataFrame:
    """method and mean squared error over k folds: the training mean, the nearest site, two blended, inverse distance and,
    if (neighbours, range, sill) are given, kriging."""
    dealt = folds(sites, k, seed, site_id)
    out = None
    for fold in range(k):
        now = dealt.where(F.col("fold") == fold)
        test, train = now.where("test").drop("test", "fold"), now.where("NOT test").drop("test", "fold")
        points = test.withColumnRenamed(site_id, "id")
        mean = train.agg(F.avg(value).alias("p"))
        predictions = {
            "mean": points.select("id").crossJoin(F.broadcast(mean)),
            "nearest": nearest(points, train, 1).join(train.select(site_id, F.col(value).alias("p")), on=F.col("site") == F.col(site_id) if site_id != "site" else "site").select("id", "p"),
            "two_nearest": two_nearest_blend(points, train, value).withColumnRenamed("blend", "p"),
            "inverse_distance": inverse_distance(points, train, value).withColumnRenamed("idw", "p"),
        }
        if kriging:
            predictions["kriging"] = krige(points, train, value, *kriging).select("id", F.col("estimate").alias("p"))
        for name, p in predictions.items():
            e = points.join(p, "id").select(F.lit(name).alias("method"), F.pow(F.col(value) - F.col("p"), F.lit(2.0)).alias("e"))
            out = e if out is None else out.union(e)
    return out.groupBy("method").agg(F.avg("e").alias("mse"), F.count("e").alias("n"))
