"""Queries of joins by key and by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import geo
from lithos.functions.maths import round_scaled
from lithos.operators import interpolate as I
from lithos.operators import joins as J
from lithos.operators import stats as S
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.views import CELLS, FLOWS, POINTS, SITES, distance, rounded, table

NEAREST = f"""WITH {POINTS}, {SITES}, d AS (SELECT p.id, p.value, s.site, {distance('p', 's')} AS dist FROM points p, sites s),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 3), site) AS rank FROM d)"""


@query(f"""{NEAREST}, z AS (SELECT site, round(avg(value), 6) AS mean_balance, count(*) AS customers, round(max(dist), 3) AS farthest FROM r WHERE rank = 1 GROUP BY 1) SELECT * FROM z""")
def nearest_zone_balance(spark, sf_dir):
    """The mean balance of the customers in each supplier's zone."""
    points = V.points(spark, sf_dir)
    near = J.nearest(points, V.sites(spark, sf_dir))
    zones = near.join(points.select("id", "value"), "id").groupBy("site").agg(F.avg("value").alias("mean_balance"), F.count(F.lit(1)).alias("customers"), F.round(F.max("dist"), 3).alias("farthest"))
    return rounded(zones)


@query(f"{NEAREST} SELECT id, site, round(dist, 3) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank = 1")
def nearest_haversine(spark, sf_dir):
    return rounded(J.nearest(V.points(spark, sf_dir), V.sites(spark, sf_dir)), 3)


@query(f"{NEAREST} SELECT id, site, round(dist, 3) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn5(spark, sf_dir):
    return rounded(J.nearest(V.points(spark, sf_dir), V.sites(spark, sf_dir), 5), 3)


@query(f"""WITH {POINTS}, {SITES}, d AS (SELECT id, site, sqrt((p.lat - s.lat) * (p.lat - s.lat) + (p.lon - s.lon) * (p.lon - s.lon)) AS dist FROM points p, sites s),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 6), site) AS rank FROM d) SELECT id, site, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank = 1""")
def nearest_planar(spark, sf_dir):
    return rounded(J.nearest(V.points(spark, sf_dir), V.sites(spark, sf_dir), metric="planar", digits=6))


@query(f"""{NEAREST} SELECT id, round(sum(v / greatest(dist, 1e-9)) / sum(1 / greatest(dist, 1e-9)), 4) AS blend FROM r JOIN sites USING (site) WHERE rank <= 2 GROUP BY 1""")
def two_nn_blend(spark, sf_dir):
    return rounded(J.two_nearest_blend(V.points(spark, sf_dir), V.sites(spark, sf_dir), "v"), 4)


@query(f"""{NEAREST} SELECT id, round(sum(v / (dist / 1000 * (dist / 1000))) / sum(1 / (dist / 1000 * (dist / 1000))), 4) AS idw FROM d JOIN sites USING (site) WHERE dist > 0 GROUP BY 1""")
def idw(spark, sf_dir):
    return rounded(J.inverse_distance(V.points(spark, sf_dir), V.sites(spark, sf_dir), "v"), 4)


@query(f"""WITH {SITES} SELECT a.site AS a, b.site AS b, round({distance('a', 'b')}, 3) AS dist, round((a.v - b.v) * (a.v - b.v) / 2, 2) AS semivariance FROM sites a JOIN sites b ON a.site < b.site
    WHERE {distance('a', 'b')} <= 20000""")
def pairs_semivariance(spark, sf_dir):
    out = J.pair_semivariance(V.sites(spark, sf_dir), "site", "v", 20000)
    return out.select("a", "b", round_scaled(F.col("dist"), 3).alias("dist"), round_scaled(F.col("semivariance"), 2).alias("semivariance"))


@query(f"WITH {POINTS}, {SITES} SELECT s.site, count(*) AS n, round(sum(p.value), 4) AS total FROM points p, sites s WHERE {distance('p', 's')} <= 15000 GROUP BY 1")
def radius_sum(spark, sf_dir):
    return rounded(J.totals_within(V.points(spark, sf_dir), V.sites(spark, sf_dir), 15000, "value"), 4)


@query(f"WITH {POINTS}, {SITES} SELECT id FROM points p WHERE EXISTS (SELECT 1 FROM sites s WHERE {distance('p', 's')} <= 4000)")
def proximity_semi(spark, sf_dir):
    return J.within(V.points(spark, sf_dir), V.sites(spark, sf_dir), 4000).select("id").distinct()


@query(f"""WITH {POINTS}, t AS (SELECT id, lat, lon, ((lat + 34.4037::DOUBLE) * 1.2::DOUBLE + (lon - 150.1071::DOUBLE) * 1.4::DOUBLE) / (1.2::DOUBLE * 1.2::DOUBLE + 1.4::DOUBLE * 1.4::DOUBLE) AS along FROM points)
    SELECT id, round(along, 6) AS along FROM t WHERE along BETWEEN 0 AND 1 AND sqrt(pow(lat - (-34.4037::DOUBLE + along * 1.2::DOUBLE), 2) + pow(lon - (150.1071::DOUBLE + along * 1.4::DOUBLE), 2)) <= 0.0517""")
def transect_band(spark, sf_dir):
    a, b = (-34.4037, 150.1071), (-33.2037, 151.5071)
    return rounded(J.transect(V.points(spark, sf_dir), a, b, 0.0517).select("id", "along"))


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return J.lookup(left, table(spark, sf_dir, "nation"), "n_nationkey", ["n_name"], ["n_nationkey"]).select("c_custkey", "c_name", "n_name")


LAST = "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity)) AS l_partkey FROM lineitem GROUP BY ALL"


@query(f"WITH r AS ({LAST}) SELECT o_orderkey, l_partkey FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND l_linenumber = 1")
def lookup_join_lastwins(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    out = J.lookup(left, table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return out.select("o_orderkey", "l_partkey")


@query(f"WITH r AS ({LAST}) SELECT o_orderkey, coalesce(CAST(l_partkey AS VARCHAR), '***JOINFAILED***') AS l_partkey FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND l_linenumber = 7")
def join_failed_marker(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("l_orderkey"), F.lit(7).alias("l_linenumber"))
    out = J.lookup(left, table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"], J.JOIN_FAILED)
    return out.select("o_orderkey", "l_partkey")


@query("SELECT d.doc_id, coalesce(quality, 1000) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def defaults_left_join(spark, sf_dir):
    return J.with_defaults(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", {"quality": 1000, "toxic": 0})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_known_regions(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.known_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_oob(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.unknown_only(table(spark, sf_dir, "customer").select("c_custkey"), known, "c_custkey")


@query(f"WITH {POINTS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points WHERE lat BETWEEN -34.105 AND -33.495 AND lon BETWEEN 150.595 AND 151.205")
def bbox_filter(spark, sf_dir):
    points = V.points(spark, sf_dir)
    return rounded(points.where(geo.in_box(points.lat, points.lon, -34.105, -33.495, 150.595, 151.205)).select("id", "lat", "lon"))


@query("SELECT c_nationkey, count(*) AS n, round(avg(o_totalprice), 9) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 135000 AND 2000000 GROUP BY 1")
def band_filter_mean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_totalprice").between(135000, 2000000)).select("o_custkey", "o_totalprice")
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), 9)


MAPPED = f"WITH {FLOWS}, w AS (SELECT r1, r2, n / sum(n) OVER (PARTITION BY r1) AS w FROM flows), v AS (SELECT c_nationkey AS r1, sum(c_acctbal) AS v FROM customer GROUP BY 1)"


def _mapping(spark, sf_dir):
    w = S.shares(V.flows(spark, sf_dir), "n", "r1", "w").select("r1", "r2", "w")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("r1")).agg(F.sum("c_acctbal").alias("v")), w


@query(f"{MAPPED} SELECT r2, round(sum(w * v), 4) AS v FROM w JOIN v USING (r1) GROUP BY 1")
def region_convert_sum(spark, sf_dir):
    return rounded(J.convert_regions(*_mapping(spark, sf_dir)), 4)


@query(f"{MAPPED} SELECT r2, round(sum(w * v) / sum(w), 4) AS v FROM w JOIN v USING (r1) GROUP BY 1")
def region_convert_avg(spark, sf_dir):
    return rounded(J.convert_regions(*_mapping(spark, sf_dir), average=True), 4)


@query(f"{MAPPED} SELECT r2, string_agg(CAST(r1 AS VARCHAR), ',' ORDER BY r1) AS members FROM w GROUP BY 1")
def invert_mapping(spark, sf_dir):
    out = J.inverted(_mapping(spark, sf_dir)[1])
    return out.select("r2", F.array_join(F.transform("members", lambda m: m["r1"].cast("string")), ",").alias("members"))


RINGS = {"zone_a": [(-34.3, 150.2), (-34.25, 151.1), (-33.61, 151.32), (-33.55, 150.33), (-34.3, 150.2)], "zone_b": [(-34.1, 150.5), (-34.1, 150.9), (-33.7, 150.9), (-33.7, 150.5), (-34.1, 150.5)], "zone_c": [(-33.5, 151.0), (-33.1, 151.6), (-33.1, 151.0), (-33.5, 151.0)]}
_EDGES = ", ".join(f"('{n}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for n, r in RINGS.items() for a, b in zip(r, r[1:]))
POLYGONS = f"""e AS (SELECT * FROM (VALUES {_EDGES}) e(name, ay, ax, y, x)), areas AS (SELECT name, abs(sum(ax * y - x * ay)) / 2 AS area FROM e GROUP BY 1)"""
CROSSED = "((ay <= lat AND lat < y) OR (y <= lat AND lat < ay)) AND lon < (x - ax) * (lat - ay) / (y - ay) + ax"


def _polygons(spark):
    return spark.createDataFrame([(n, [(float(a), float(b)) for a, b in r]) for n, r in RINGS.items()], "name string, ring array<struct<lat: double, lon: double>>")


@query(f"""WITH {POINTS}, {POLYGONS}, h AS (SELECT id, name, count(*) AS n FROM points, e WHERE {CROSSED} GROUP BY ALL),
    b AS (SELECT id, arg_min(name, (area, name)) AS name FROM h JOIN areas USING (name) WHERE n % 2 = 1 GROUP BY 1) SELECT points.id, b.name FROM points LEFT JOIN b USING (id)""")
def point_in_polygon(spark, sf_dir):
    return J.in_polygons(V.points(spark, sf_dir), _polygons(spark), 0.25).select("id", "name")


@query("""WITH v AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS y, l_tax::DOUBLE * 100 AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax)),
    e AS (SELECT a.k, o.x AS ox, o.y AS oy, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM v a JOIN v b ON b.k = a.k AND b.i = a.i % a.n + 1 JOIN v o ON o.k = a.k AND o.i = 1)
    SELECT k AS l_orderkey, round(abs(sum((ax - ox) * (b_y - oy) - (bx - ox) * (ay - oy))) / 2, 6) AS area FROM e GROUP BY k""")
def shoelace(spark, sf_dir):
    """Area of the ring whose vertices are an order's lines, by quantity and tax."""
    vertex = F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("lat"), (F.col("l_tax").cast("double") * 100).alias("lon"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    ring = F.transform(F.concat("v", F.slice("v", 1, 1)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return rounded(lines.select("l_orderkey", ring.alias("ring")).select("l_orderkey", geo.ring_area(F.col("ring")).alias("area")))


@query(f"""WITH {POINTS}, {SITES}, b AS (SELECT nation, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM sites GROUP BY 1),
    t AS (SELECT id, nation, unnest([lat, lat + 0.01::DOUBLE, lat + 0.005::DOUBLE]) AS lat, unnest([lon, lon + 0.005::DOUBLE, lon + 0.01::DOUBLE]) AS lon FROM points)
    SELECT id, bool_and(lat >= s AND lat < n AND lon >= w AND lon < e) AS inside FROM t JOIN b USING (nation) GROUP BY id""")
def polygon_contains(spark, sf_dir):
    """Whether a small triangle at each customer lies in the box around the suppliers of the customer's nation."""
    at = lambda a, b: F.struct((F.col("lat") + F.lit(a)).alias("lat"), (F.col("lon") + F.lit(b)).alias("lon"))
    small = V.points(spark, sf_dir).select("id", "nation", F.array(F.struct("lat", "lon"), at(0.01, 0.005), at(0.005, 0.01)).alias("inner"))
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    sides = V.sites(spark, sf_dir).groupBy("nation").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    boxes = sides.select("nation", F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w"), corner("s", "w")).alias("outer"))
    return small.join(boxes, "nation").select("id", geo.ring_contains(F.col("outer"), F.col("inner")).alias("inside"))


@query(f"""WITH {POINTS} SELECT id, CASE WHEN lat BETWEEN -34.505 AND -34.005 THEN 0 WHEN lat BETWEEN -33.995 AND -33.495 THEN 1 ELSE -1 END AS sector FROM points""")
def sectors(spark, sf_dir):
    boxes = spark.createDataFrame([(0, -34.505, -34.005, 149.0, 153.0), (1, -33.995, -33.495, 149.0, 153.0)], "sector int, s double, n double, w double, e double")
    return J.in_boxes(V.points(spark, sf_dir), boxes).select("id", "sector")


@query("""WITH t AS (SELECT o_orderstatus, o_orderpriority AS dim, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT o_orderstatus, round(sum(v * CASE dim WHEN '1-URGENT' THEN 0.5::DOUBLE WHEN '2-HIGH' THEN 0.3::DOUBLE ELSE 0 END), 8) AS score FROM t GROUP BY 1""")
def scored_options(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return rounded(J.scored_options(t, "o_orderstatus", "o_orderpriority", "v", {"1-URGENT": 0.5, "2-HIGH": 0.3}).select("o_orderstatus", "score"), 8)


@query("""WITH RECURSIVE s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS source, CAST(floor(epoch(ts)) AS BIGINT) // 600 AS t FROM events),
    a AS (SELECT s.source, s.t, p.t AS p FROM s ASOF LEFT JOIN s p ON s.source = p.source AND s.t + 30 <= p.t),
    b AS (SELECT a.source, a.t, CASE WHEN p < a.t + 120 THEN p END AS partner, coalesce(CASE WHEN p < a.t + 120 THEN p END, q.t) AS next FROM a ASOF LEFT JOIN s q ON a.source = q.source AND a.t + 120 <= q.t),
    w AS (SELECT source, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT b.source, b.next FROM w JOIN b USING (source, t) WHERE b.next IS NOT NULL)
    SELECT source, t AS t0, partner AS t1 FROM w JOIN b USING (source, t) WHERE partner IS NOT NULL""")
def gap_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 600).alias("t"))
    return J.gap_pairs(events, "user", F.col("t")).orderBy("source", "t0")


@query()
def kriging(spark, sf_dir):
    sites = V.sites(spark, sf_dir).groupBy("lat", "lon").agg(F.min("site").alias("site"), F.avg("v").alias("v"))
    rng, sill = I.fit_variogram(sites, "site", "v", 60000)
    return I.krige(V.points(spark, sf_dir), sites, "v", 8, rng, sill)


@query(f"WITH {CELLS} SELECT count(*) AS cells FROM cells")
def cell_count(spark, sf_dir):
    return V.cells(spark, sf_dir).agg(F.count(F.lit(1)).alias("cells"))


@query(f"""WITH {SITES}, p AS (SELECT a.lat AS y, a.lon AS x, b.lat AS v, b.lon AS u, {distance('a', 'b')} AS dist, (a.v - b.v) * (a.v - b.v) / 2 AS g FROM sites a JOIN sites b ON a.site < b.site),
    t AS (SELECT dist, g, v - y AS north, (u - x) * cos(radians((y + v) / 2)) AS east FROM p WHERE dist <= 40000),
    w AS (SELECT dist, g, east * cos(radians(30::DOUBLE)) + north * sin(radians(30::DOUBLE)) AS along, north * cos(radians(30::DOUBLE)) - east * sin(radians(30::DOUBLE)) AS across FROM t),
    k AS (SELECT *, CASE WHEN abs(across) <= abs(along) * tan(radians(22.5::DOUBLE)) THEN 0 WHEN abs(along) <= abs(across) * tan(radians(22.5::DOUBLE)) THEN 1 END AS axis FROM w)
    SELECT axis, CAST(floor(dist / 2000) AS INTEGER) AS lag, round(avg(dist), 3) AS d, round(avg(g), 2) AS g, count(*) AS n FROM k WHERE axis IS NOT NULL GROUP BY ALL""")
def directional_variogram(spark, sf_dir):
    """Semivariances of sites by distance along an axis 30 degrees north of east, and across it."""
    out = I.directional_bins(V.sites(spark, sf_dir), "site", "v", 40000, 30)
    return out.select("axis", "lag", F.round("d", 3).alias("d"), F.round("g", 2).alias("g"), "n")
