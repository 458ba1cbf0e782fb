"""Joins by key, by place and by distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import geo
from lithos.operators.stats import keys_of
from lithos.scratch import Scratch

JOIN_FAILED = "***JOINFAILED***"
#: Sites up to this many rows are broadcast; beyond, they are dealt into blocks of as many rows.
SITES = 20_000
#: Up to this many sites are one array that each point looks through.
FEW_SITES = 64
#: Sites of one place whose pairs are unfolded together.
TOGETHER = 200
#: Of places that repeat this often or more, each is measured once for all that is there.
REPEATS = 1.5
#: Nine cells with more sites than this are dense: their points begin with finer cells, down to FINEST degrees. A finer
#: round leaves a sixteenth of the sites to measure, of which a third lie within its reach, and costs a pass over the points.
CROWD = 128
FINEST = 1e-4


def lookup(left: DataFrame, right: DataFrame, keys, columns: list[str], order: list, failed: str | None = None) -> DataFrame:
    """`left` with `columns` of the row of `right` with the same keys; of several the last in `order`, which should be total.
    Keys are compared without white space around them. Rows without a partner get nulls, or the text `failed`."""
    on = keys_of(keys)
    trimmed = lambda df: [F.trim(F.col(k)) if dict(df.dtypes)[k] == "string" else F.col(k) for k in on]
    names = [f"__k{i}" for i in range(len(on))]
    last = right.groupBy(*(c.alias(n) for c, n in zip(trimmed(right), names))).agg(F.max(F.struct(*order, *(F.col(c).alias(f"__v_{c}") for c in columns))).alias("__last"))
    keyed = left
    for c, n in zip(trimmed(left), names):
        keyed = keyed.withColumn(n, c)
    found = keyed.join(last, names, "left")
    value = lambda c: F.col(f"__last.__v_{c}") if failed is None else F.when(F.col("__last").isNull(), failed).otherwise(F.col(f"__last.__v_{c}").cast("string"))
    return found.select(*left.columns, *(value(c).alias(c) for c in columns))


def with_defaults(left: DataFrame, right: DataFrame, keys, defaults: dict) -> DataFrame:
    """Left join that puts `defaults` where there is no partner or no value."""
    out = left.join(right.select(*keys_of(keys), *defaults), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known."""
    return rows.join(known, key, "left_semi")


def unknown_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known, key, "left_anti")


def require_all(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows`; raises KeyError, with one of the keys, if any is unknown."""
    lost = unknown_only(rows, known, key).select(key).first()
    if lost is not None:
        raise KeyError(lost[0])
    return rows


def require_unique(rows: DataFrame, keys) -> DataFrame:
    """`rows`; raises ValueError, with one of the keys, if any repeats."""
    twice = rows.groupBy(*keys_of(keys)).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"repeated key {tuple(twice)[:-1]}")
    return rows


def _around(cells: DataFrame) -> DataFrame:
    """Rows of `cells` (__y, __x) dealt to their cell and the eight around it."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    moved = cells.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    return moved.withColumns({"__y": F.col("__y") + F.col("__dy"), "__x": F.col("__x") + F.col("__dx")}).drop("__dy", "__dx")


def nearest(
    points: DataFrame, sites: DataFrame, k: int = 1, point_id: str = "id", site_id: str = "site", metric: str = "haversine", cell: float = 0.25, digits: int = 3, few: int = FEW_SITES, crowd: int | None = None
) -> DataFrame:
    """point_id, site_id, dist, rank of the k nearest sites of each point (both with lat, lon); ties of distances, rounded to
    `digits`, go to the smaller site id. Points' ids are distinct; rows without a place take no part.

    Up to `few` sites ride with each point as one array: no shuffle. More are dealt into cells of `cell` degrees; a point meets
    those of its cell and the eight around it. It is done when its k-th distance can't be beaten from farther cells; what is
    left goes on with cells of four times the size, and at the end with all sites in blocks. Where nine cells hold more than
    `crowd` sites (CROWD, or 96 a neighbour asked for), the points in their middle begin with cells of a quarter of the size,
    and so on, so that dense places cost no more than others. Where points share places, each place is looked up once and its
    points are told by a join; of sites at one place only the k smallest ids count. With `haversine` longitudes go round: sites
    near 180 degrees stand in the cells beyond it too, and points close to a pole meet all sites.
    """
    globe = metric == "haversine"
    lon = F.col("lon").cast("double")
    lon = F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180) if globe else lon
    scratch = Scratch(points.sparkSession, "nearest")
    s = sites.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(site_id).alias("__site"), F.col("lat").cast("double").alias("__slat"), lon.alias("__slon"))
    left = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(point_id).alias("__point"), F.col("lat").cast("double").alias("__lat"), lon.alias("__lon"))
    measure = {"haversine": geo.haversine, "planar": geo.planar, "planar_squared": geo.planar_squared}[metric]
    dist = lambda slat, slon: measure(F.col("__lat"), F.col("__lon"), slat, slon)
    facts = s.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("__slat", "__slon")).alias("places"), F.min("__slon").alias("west"), F.max("__slon").alias("east")).first()
    crowd = max(CROWD, 96 * k) if crowd is None else crowd
    if facts.n <= few:
        every = s.agg(F.collect_list(F.struct("__site", "__slat", "__slon")).alias("__sites"))
        met = F.transform("__sites", lambda x: F.struct(dist(x["__slat"], x["__slon"]).alias("dist"), x["__site"].alias("site")))
        keyed = F.transform(met, lambda x: F.struct(F.round(x["dist"], digits).alias("near"), x["site"].alias("site"), x["dist"].alias("dist")))
        best = left.crossJoin(F.broadcast(every)).select("__point", F.posexplode(F.slice(F.array_sort(keyed), 1, k)).alias("pos", "of"))
        return best.select(F.col("__point").alias(point_id), F.col("of.site").alias(site_id), "of.dist", (F.col("pos") + 1).alias("rank"))

    at_place = Window.partitionBy("__slat", "__slon").orderBy("__site")
    firsts = lambda s: scratch.save(s.withColumn("__nth", F.row_number().over(at_place)).where(F.col("__nth") <= k).drop("__nth"))
    every, left = left, _places(left, scratch)
    if facts.n > REPEATS * facts.places:
        s = firsts(s)
        n_sites = s.count()
    else:
        n_sites = facts.n

    def placed(df, lat, lon):
        return df.withColumns({"__y": F.floor(F.col(lat) / cell), "__x": F.floor(F.col(lon) / cell)})

    def placed_sites():
        both = s
        if globe and facts.n and facts.east > 180 - 2 * cell:
            both = both.union(s.where(F.col("__slon") > 180 - 2 * cell).withColumn("__slon", F.col("__slon") - 360))
        if globe and facts.n and facts.west < 2 * cell - 180:
            both = both.union(s.where(F.col("__slon") < 2 * cell - 180).withColumn("__slon", F.col("__slon") + 360))
        return placed(both, "__slat", "__slon")

    crowded = {}
    while n_sites > crowd and cell > FINEST:
        counts = _around(placed_sites().groupBy("__y", "__x").agg(F.count(F.lit(1)).alias("n")))
        full = counts.groupBy("__y", "__x").agg(F.sum("n").alias("n")).where(F.col("n") > crowd).select("__y", "__x")
        if full.isEmpty():
            break
        crowded[cell] = scratch.save(full)
        cell /= 4
    if cell <= FINEST:
        s = firsts(s)
    order = Window.partitionBy("__point").orderBy(F.round("dist", digits), "__site")
    found, shared = [], left
    while True:
        last = cell > (100 if globe else 400)  # three cells must not go round the globe
        if last:
            met = in_blocks(left, s)
        else:
            now = left
            if cell * 4 in crowded:
                full = crowded[cell * 4].withColumnsRenamed({"__y": "__cy", "__x": "__cx"})
                now = left.join(full, (F.floor(F.col("__lat") / (cell * 4)) == F.col("__cy")) & (F.floor(F.col("__lon") / (cell * 4)) == F.col("__cx")), "left_semi")
            met = _around(placed(now, "__lat", "__lon")).join(placed_sites(), ["__y", "__x"])
        near = met.select("__point", "__lat", "__site", dist(F.col("__slat"), F.col("__slon")).alias("dist"))
        ranked = scratch.save(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if last:
            found.append(ranked)
            break
        highest = F.cos(F.radians(F.least(F.abs(F.col("__lat")) + cell, F.lit(90.0))))
        reach = 2 * geo.EARTH_M * 0.999 * F.asin(highest * F.sin(F.radians(F.lit(cell / 2)))) if globe else F.lit(cell)
        reach = reach * reach if metric == "planar_squared" else reach
        done = ranked.groupBy("__point").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"), F.first("__lat").alias("__lat"))
        # a site beyond the reach must not tie after rounding either
        done = done.where((F.col("n") >= k) & (F.col("far") <= reach - 10.0**-digits)).select("__point")
        found.append(ranked.join(done, "__point", "left_semi"))
        left = scratch.save(left.join(done, "__point", "left_anti"))
        if left.isEmpty():
            break
        cell *= 4
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    if shared is not every:
        told = out.select("__point", "__site", "dist", "rank").join(shared, "__point").select(F.col("__lat").alias("__y"), F.col("__lon").alias("__x"), "__site", "dist", "rank")
        out = every.join(scratch.save(told), (F.col("__lat") == F.col("__y")) & (F.col("__lon") == F.col("__x")))
    return out.select(F.col("__point").alias(point_id), F.col("__site").alias(site_id), "dist", "rank")


def _places(points: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct places of points (__point, __lat, __lon), with numbers for __point; `points` itself where few places repeat."""
    n, places = points.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("__lat", "__lon"))).first()
    if n <= REPEATS * places:
        return points
    return scratch.save(points.select("__lat", "__lon").distinct().select(F.monotonically_increasing_id().alias("__point"), "__lat", "__lon"))


def in_blocks(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Every point with every site, for sums over all sites: sites are broadcast up to SITES rows, else dealt into blocks
    that each point meets one by one, in tasks of their own. Sum by point; don't keep the pairs."""
    n = sites.count()
    if n <= SITES:
        return points.crossJoin(F.broadcast(sites))
    blocks = math.ceil(n / SITES)
    dealt = sites.withColumn("__block", F.pmod(F.xxhash64(*sites.columns), F.lit(blocks)))
    return points.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(dealt, "__block").drop("__block")


def within(points: DataFrame, sites: DataFrame, metres: float) -> DataFrame:
    """Pairs of a point (lat, lon) and a site (lat, lon, other names), with `dist`, at most `metres` apart. Both are dealt
    into bands and cells as wide as the radius; a point meets the nine cells around it. Sites' columns get the prefix s_."""
    step = geo.degrees_lat(metres) * 1.001
    s = sites.select(*(F.col(c).alias(f"s_{c}") for c in sites.columns))
    # a band's cells are as wide as its farthest latitude from the equator needs
    wide = lambda y: step / F.greatest(F.cos(F.radians(F.least((F.greatest(F.abs(y), F.abs(y + 1)) + 1) * step, F.lit(89.0)))), F.lit(0.01))
    y = F.floor(F.col("s_lat") / step)
    s = s.withColumn("__y", y).withColumn("__x", F.floor(F.col("s_lon") / wide(y)))
    steps = F.sequence(F.lit(-1), F.lit(1))
    p = points.withColumn("__dy", F.explode(steps)).withColumn("__y", F.floor(F.col("lat") / step) + F.col("__dy"))
    p = p.withColumn("__dx", F.explode(steps)).withColumn("__x", F.floor(F.col("lon") / wide(F.col("__y"))) + F.col("__dx"))
    met = p.join(s, ["__y", "__x"]).withColumn("dist", geo.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")))
    return met.where(F.col("dist") <= metres).drop("__y", "__x", "__dy", "__dx")


def totals_within(points: DataFrame, sites: DataFrame, metres: float, value: str, site_id: str = "site") -> DataFrame:
    """site_id, n, total: how many points lie at most `metres` from each site that has any, and the sum of their values. Places
    are held against places, however many points and sites share them."""
    scratch = Scratch(points.sparkSession, "within")
    p = points.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__total"))
    near = within(p, sites.select("lat", "lon").distinct(), metres).groupBy("s_lat", "s_lon").agg(F.sum("__n").alias("__n"), F.sum("__total").alias("__total"))
    told = scratch.save(near.withColumnsRenamed({"s_lat": "lat", "s_lon": "lon"}))
    return sites.select(site_id, "lat", "lon").join(told, ["lat", "lon"]).groupBy(site_id).agg(F.sum("__n").alias("n"), F.sum("__total").alias("total"))


def two_nearest_blend(points: DataFrame, sites: DataFrame, value: str, point_id: str = "id", site_id: str = "site") -> DataFrame:
    """Values of the two nearest sites weighted by 1 / distance; that of a site at the point itself. Points of one place get one
    blend. Points without a place get none."""
    scratch = Scratch(points.sparkSession, "blend")
    at = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    places = scratch.save(at.select(F.monotonically_increasing_id().alias("__place"), "lat", "lon"))
    near = nearest(places, sites, 2, "__place", site_id).join(sites.select(site_id, value), site_id)
    w = 1 / F.greatest(F.col("dist"), F.lit(1e-9))
    blend = near.groupBy("__place").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("__blend"))
    told = scratch.save(places.join(blend, "__place").select("lat", "lon", "__blend"))
    return points.select(point_id, "lat", "lon").join(told, ["lat", "lon"]).select(point_id, F.col("__blend").alias("blend"))


def inverse_distance(points: DataFrame, sites: DataFrame, value: str, point_id: str = "id") -> DataFrame:
    """Values of all sites weighted by 1 / km^2; a site at the point itself takes no part. What a place is told is the same for
    all of its points, and the sites of a place weigh as one with their sum: places are measured, not points and sites."""
    s = sites.groupBy(F.col("lat").alias("__slat"), F.col("lon").alias("__slon")).agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    p = points.select(F.col(point_id).alias("__point"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    scratch = Scratch(points.sparkSession, "idw")
    d = geo.haversine(F.col("__lat"), F.col("__lon"), F.col("__slat"), F.col("__slon")) / 1000
    met = in_blocks(p.select("__lat", "__lon").distinct(), scratch.save(s)).withColumn("__w", F.when(d > 0, 1 / (d * d)))
    sums = met.groupBy("__lat", "__lon").agg(F.sum(F.col("__v") * F.col("__w")).alias("__top"), F.sum(F.col("__n") * F.col("__w")).alias("__of"))
    told = scratch.save(sums.withColumnsRenamed({"__lat": "__y", "__lon": "__x"}))
    found = p.join(told, F.col("__lat").eqNullSafe(F.col("__y")) & F.col("__lon").eqNullSafe(F.col("__x")))
    return found.groupBy(F.col("__point").alias(point_id)).agg(F.try_divide(F.sum("__top"), F.sum("__of")).alias("idw"))


def pair_semivariance(sites: DataFrame, ident: str, value: str, metres: float) -> DataFrame:
    """a, b (a < b), distance and half the squared difference of the values of sites at most `metres` apart."""
    return placed_pairs(sites, ident, value, metres).select("a", "b", "dist", "semivariance")


def placed_pairs(sites: DataFrame, ident: str, value: str, metres: float) -> DataFrame:
    """pair_semivariance() with the places of each pair, in either order: lat, lon, s_lat, s_lon. Places are measured once for all
    of their sites; what they give is unfolded from parts of TOGETHER sites, so that no task holds many."""
    scratch = Scratch(sites.sparkSession, "pairs")
    s = sites.where(F.col(ident).isNotNull()).select("lat", "lon", F.struct(F.col(ident).alias("id"), F.col(value).alias("v")).alias("__of"))
    counts = scratch.save(s.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("__n")))
    dealt = s.join(counts, ["lat", "lon"]).withColumn("__part", F.pmod(F.xxhash64("__of.id"), F.ceil(F.col("__n") / TOGETHER)))
    parts = dealt.groupBy("lat", "lon", "__part").agg(F.collect_list("__of").alias("__of"))
    parts = scratch.save(parts.withColumn("__k", F.monotonically_increasing_id()).drop("__part"))
    # what a task unfolds grows with its parts times all sites around, so there are as many tasks as all sites ask for
    n = counts.agg(F.sum("__n")).first()[0] or 0
    near = within(parts.repartition(max(1, math.ceil(n / TOGETHER))), parts, metres).where("__k <= s___k")
    kept = "lat", "lon", "s_lat", "s_lon", "dist"
    unfolded = near.select(*kept, (F.col("__k") == F.col("s___k")).alias("__same"), "s___of", F.explode("__of").alias("__a")).select(*kept, "__same", "__a", F.explode("s___of").alias("__b"))
    a, b = F.col("__a.id"), F.col("__b.id")
    diff = F.col("__a.v") - F.col("__b.v")
    pairs = unfolded.where((a < b) | (~F.col("__same") & (a > b)))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *kept, (diff * diff / 2).alias("semivariance"))


def transect(points: DataFrame, a: tuple[float, float], b: tuple[float, float], tolerance: float) -> DataFrame:
    """Points (lat, lon) within `tolerance` degrees of the segment a-b whose foot lies on it, with `along` (0 to 1)."""
    fy, fx, t = geo.perpendicular_foot(F.col("lat"), F.col("lon"), a[0], a[1], b[0], b[1])
    return points.withColumn("along", t).where((t >= 0) & (t <= 1) & (geo.planar(F.col("lat"), F.col("lon"), fy, fx) <= tolerance))


def convert_regions(values: DataFrame, mapping: DataFrame, average: bool = False) -> DataFrame:
    """Values (r1, v) moved to other regions by weights (r1, r2, w): sums of w * v, or their weighted mean. Regions without
    a mapping are dropped."""
    joined = mapping.join(values, "r1")
    total = F.sum(F.col("w") * F.col("v"))
    return joined.groupBy("r2").agg((F.try_divide(total, F.sum("w")) if average else total).alias("v"))


def inverted(mapping: DataFrame) -> DataFrame:
    """For each r2 the sorted list of (r1, w) that map to it."""
    return mapping.groupBy("r2").agg(F.sort_array(F.collect_list(F.struct("r1", "w"))).alias("members"))


def part(array: str, name: str) -> Column:
    """The field `name` of each struct of an array."""
    return F.transform(array, lambda v: v.getField(name))


def in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0, point_id: str = "id") -> DataFrame:
    """`points` (lat, lon) with the polygon (name, ring) that holds each; the one with the smallest area of several, then
    the first name. Boxes are dealt into cells of `cell` degrees, so that a point meets the polygons of its cell only."""
    lat, lon = (part("ring", c) for c in ("lat", "lon"))
    boxed = polygons.select("name", "ring", geo.ring_area(F.col("ring")).alias("area"), *(f(x).alias(n) for n, f, x in (("s", F.array_min, lat), ("n", F.array_max, lat), ("w", F.array_min, lon), ("e", F.array_max, lon))))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    celled = boxed.withColumn("__y", F.explode(span("s", "n"))).withColumn("__x", F.explode(span("w", "e")))
    placed = points.withColumn("__y", F.floor(F.col("lat") / cell)).withColumn("__x", F.floor(F.col("lon") / cell))
    hit = placed.join(celled, ["__y", "__x"]).where(geo.in_box(F.col("lat"), F.col("lon"), F.col("s"), F.col("n"), F.col("w"), F.col("e")) & geo.point_in_ring(F.col("lat"), F.col("lon"), F.col("ring")))
    best = hit.groupBy(point_id).agg(F.min(F.struct("area", "name")).alias("__best")).select(point_id, F.col("__best.name").alias("name"))
    return points.join(best, point_id, "left")


def in_boxes(points: DataFrame, boxes: DataFrame, point_id: str = "id") -> DataFrame:
    """`points` with `sector`, the number of the box (sector, s, n, w, e) that holds it, -1 if none does. Raises ValueError if
    two hold one point. Boxes are a short list of settings."""
    hit = points.join(F.broadcast(boxes), geo.in_box(F.col("lat"), F.col("lon"), F.col("s"), F.col("n"), F.col("w"), F.col("e")), "left")
    require_unique(hit, point_id)
    return hit.select(*points.columns, F.coalesce("sector", F.lit(-1)).alias("sector"))


def scored_options(options: DataFrame, by: str, dim: str, value: str, weights: dict[str, float]) -> DataFrame:
    """Long (by, dim, value) made wide, with the weighted `score` of the dimensions; a missing one counts 0."""
    wide = options.groupBy(by).pivot(dim, list(weights)).agg(F.first(value))
    return wide.withColumn("score", sum((F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in weights.items()), F.lit(0.0)))


def gap_pairs(rows: DataFrame, source: str, ts: Column, least: int = 30, most: int = 120) -> DataFrame:
    """source, t0, t1 (seconds): from a sentinel at t0 the first later one in [t0 + least, t0 + most) is its partner and the
    next start; without one the search jumps `most` seconds on. Sequential by nature, so a source at a time; its times are
    distinct seconds, which bounds a group by the length of the record, not by its number of rows."""
    times = rows.select(F.col(source).alias("source"), F.floor(ts).alias("t")).distinct()

    def walk(pdf):
        import numpy as np
        import pandas as pd

        t = np.sort(pdf["t"].to_numpy())
        out, at = [], t[0] if len(t) else None
        while at is not None:
            i = np.searchsorted(t, at + least)
            if i < len(t) and t[i] < at + most:
                out.append((at, t[i]))
                at = t[i]
            else:
                i = np.searchsorted(t, at + most)
                at = t[i] if i < len(t) else None
        return pd.DataFrame({"source": [pdf["source"].iloc[0]] * len(out), "t0": [a for a, _ in out], "t1": [b for _, b in out]})

    kind = dict(times.dtypes)["source"]
    return times.groupBy("source").applyInPandas(walk, f"source {kind}, t0 long, t1 long")
