"""Geometry on columns: distances, boxes, rings. All angles in degrees, all distances in metres unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6372795.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    chord = half(a - b) + F.cos(a) * F.cos(b) * half(F.radians(lon1) - F.radians(lon2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def distance_3d(flat: Column, height: Column) -> Column:
    return F.sqrt(flat * flat + height * height)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(planar_squared(x1, y1, x2, y2))


def planar_squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def in_box(lat: Column, lon: Column, south, north, west, east) -> Column:
    """Whether a point lies in a box, its edges included."""
    return lat.between(south, north) & lon.between(west, east)


def degrees_lat(metres: float) -> float:
    """Degrees of latitude that `metres` span."""
    return metres / EARTH_M * 180.0 / 3.141592653589793


def wrap_lat(lat: Column) -> Column:
    return F.when(lat > 90, 180 - lat).otherwise(lat)


def wrap_lon(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def bearing_class(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """One of N, NE, E, SE, S, SW, W, NW: the 45-degree sector of the way from the first point to the second."""
    north, east = lat2 - lat1, (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    sector = F.pmod(F.floor(F.degrees(F.atan2(east, north)) / 45 + 0.5), F.lit(8))
    return F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (sector + 1).cast("int"))


def perpendicular_foot(px: Column, py: Column, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """x, y of the foot of the perpendicular from a point to the line through a and b, and its place along a-b (0 to 1)."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)
    return ax + t * dx, ay + t * dy, t


# A ring is an array of structs (lat, lon) whose last vertex equals its first.


def edges(ring: Column) -> Column:
    """The ring's edges as structs (a, b)."""
    n = F.size(ring)
    ahead = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test by ray casting; an edge holds its lower end and not its upper one."""
    def crossed(e):
        (ay, ax), (by, bx) = ((e.getField(p).getField("lat"), e.getField(p).getField("lon")) for p in ("a", "b"))
        spans = ((ay <= lat) & (lat < by)) | ((by <= lat) & (lat < ay))
        return spans & (lon < (bx - ax) * (lat - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax)

    return F.pmod(F.size(F.filter(edges(ring), crossed)), F.lit(2)) == 1


def ring_contains(outer: Column, inner: Column) -> Column:
    """Whether every vertex of `inner` lies in `outer`."""
    return F.forall(inner, lambda v: point_in_ring(v["lat"], v["lon"], outer))


def ring_in_box(ring: Column, south, north, west, east) -> Column:
    return F.forall(ring, lambda v: in_box(v["lat"], v["lon"], south, north, west, east))


def _fold(ring: Column, term) -> Column:
    return F.aggregate(F.transform(edges(ring), term), F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    """Shoelace area in square degrees, about the first vertex; positive when lon turns to lat counter-clockwise."""
    o = ring[0]
    return _fold(ring, lambda e: (e["a"]["lon"] - o["lon"]) * (e["b"]["lat"] - o["lat"]) - (e["b"]["lon"] - o["lon"]) * (e["a"]["lat"] - o["lat"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Centre of area as a struct (lat, lon); the vertices' mean if the area is 0."""
    o, area = ring[0], signed_area(ring)
    cross = lambda e: (e["a"]["lon"] - o["lon"]) * (e["b"]["lat"] - o["lat"]) - (e["b"]["lon"] - o["lon"]) * (e["a"]["lat"] - o["lat"])
    at = lambda c: F.when(area == 0, vertex_mean(ring)[c]).otherwise(o[c] + _fold(ring, lambda e: (e["a"][c] + e["b"][c] - 2 * o[c]) * cross(e)) / F.when(area == 0, F.lit(1.0)).otherwise(6 * area))
    return F.struct(at("lat").alias("lat"), at("lon").alias("lon"))


def vertex_mean(ring: Column) -> Column:
    open_ = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda c: F.aggregate(F.transform(open_, lambda v: v[c]), F.lit(0.0), lambda s, x: s + x) / F.size(open_)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def is_concave(ring: Column) -> Column:
    """Whether the ring turns both ways."""
    e = edges(ring)
    ahead = F.concat(F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, 1, 1))
    turn = F.zip_with(e, ahead, lambda p, q: (p["b"]["lon"] - p["a"]["lon"]) * (q["b"]["lat"] - q["a"]["lat"]) - (p["b"]["lat"] - p["a"]["lat"]) * (q["b"]["lon"] - q["a"]["lon"]))
    return F.exists(turn, lambda x: x > 0) & F.exists(turn, lambda x: x < 0)


def clockwise(ring: Column) -> Column:
    """The ring with clockwise orientation in (lon, lat)."""
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)
