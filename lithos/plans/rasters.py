"""Queries of raster layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import grid as G
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.views import CELLS, GRID, OTHER, POINTS, REGIONS, rounded

LATI = "CAST(least(floor((lat + 34.5::DOUBLE) / 1.5::DOUBLE * 40), 39) AS INTEGER)"
LONI = "CAST(least(floor((lon - 150.0::DOUBLE) / 1.7::DOUBLE * 40), 39) AS INTEGER)"


def layer(sql: str) -> str:
    """An oracle's result rounded as cells are."""
    return f"SELECT lati, loni, round(value, 6) + 0.0::DOUBLE AS value FROM ({sql})"


@query(f"WITH {POINTS}, {CELLS}, p AS (SELECT *, {LATI} AS lati, {LONI} AS loni FROM points) SELECT id, round(c.value, 6) AS sampled FROM p LEFT JOIN cells c USING (lati, loni)")
def raster_sample(spark, sf_dir):
    return rounded(G.sample(V.points(spark, sf_dir), V.cells(spark, sf_dir), GRID, "sampled").select("id", "sampled"))


@query(f"""WITH {POINTS}, {CELLS}, p AS (SELECT id, {LATI} AS i, {LONI} AS j, (lat + 34.5::DOUBLE) / (1.5::DOUBLE / 40) - 0.5 AS y, (lon - 150.0::DOUBLE) / (1.7::DOUBLE / 40) - 0.5 AS x FROM points),
    n AS (SELECT id, value, sqrt((y - lati) * (y - lati) + (x - loni) * (x - loni)) AS d FROM p JOIN cells ON lati BETWEEN i - 1 AND i + 1 AND loni BETWEEN j - 1 AND j + 1)
    SELECT id, round(coalesce(arg_min(value, (d, value)) FILTER (d < 0.05), sum(value / greatest(d, 1e-9)) / sum(1 / greatest(d, 1e-9))), 4) AS value FROM n GROUP BY 1""")
def raster_sample_interp(spark, sf_dir):
    return rounded(G.sample_smooth(V.points(spark, sf_dir), V.cells(spark, sf_dir), GRID), 4)


ZONAL = f"{REGIONS}, {CELLS}, z AS (SELECT r.value AS region, avg(c.value) AS mean, sum(c.value) AS total, count(c.value) AS n FROM regions r JOIN cells c USING (lati, loni) GROUP BY 1)"


@query(f"WITH {ZONAL} SELECT region, round(mean, 6) AS mean, round(total, 6) AS total, n FROM z")
def zonal_mean(spark, sf_dir):
    return rounded(G.zonal(V.regions(spark, sf_dir), V.cells(spark, sf_dir)))


@query(f"WITH {ZONAL} " + layer("SELECT lati, loni, mean AS value FROM regions LEFT JOIN z ON z.region = regions.value"))
def zonal_paint(spark, sf_dir):
    regions = V.regions(spark, sf_dir)
    return rounded(G.paint(regions, G.zonal(regions, V.cells(spark, sf_dir)), "mean"))


@query(f"""WITH {REGIONS}, o AS (SELECT CAST(s_suppkey % 40 AS INTEGER) AS lati, CAST((s_suppkey // 40) % 40 AS INTEGER) AS loni, max(s_nationkey) AS value FROM supplier GROUP BY ALL),
    c AS (SELECT r.value AS a, o.value AS b, count(*) AS cells FROM regions r LEFT JOIN o USING (lati, loni) GROUP BY ALL) SELECT a, b, cells, CAST(sum(cells) OVER (PARTITION BY a) AS BIGINT) AS total FROM c""")
def overlap_counts(spark, sf_dir):
    other = V._cells(V.table(spark, sf_dir, "supplier"), "s_suppkey", F.max("s_nationkey"))
    return G.overlap(V.regions(spark, sf_dir), other).select("a", "b", "cells", "total")


MASK = "mask AS (SELECT lati, loni, (lati + loni) % 3 AS value FROM cells)"


def _mask(spark, sf_dir):
    return V.cells(spark, sf_dir).select("lati", "loni", ((F.col("lati") + F.col("loni")) % 3).alias("value"))


@query(f"WITH {CELLS}, {MASK} " + layer("SELECT c.lati, c.loni, CASE WHEN m.value > 0 THEN m.value ELSE c.value END AS value FROM cells c JOIN mask m USING (lati, loni)"))
def mask_in(spark, sf_dir):
    return rounded(G.masked(V.cells(spark, sf_dir), _mask(spark, sf_dir), True, "mask"))


@query(f"WITH {CELLS}, {MASK} " + layer("SELECT c.lati, c.loni, CASE WHEN m.value > 0 THEN c.value END AS value FROM cells c JOIN mask m USING (lati, loni)"))
def mask_out(spark, sf_dir):
    return rounded(G.masked(V.cells(spark, sf_dir), _mask(spark, sf_dir), False))


@query(f"WITH {CELLS}, {OTHER} " + layer("SELECT * FROM cells WHERE (lati, loni) IN (SELECT (lati, loni) FROM other)"))
def crop(spark, sf_dir):
    return rounded(G.cropped(V.cells(spark, sf_dir), V.other(spark, sf_dir)))


@query(f"WITH {CELLS}, b AS (SELECT min(value) AS lo FROM cells) " + layer("SELECT lati, loni, ln(value + CASE WHEN lo >= 1 THEN lo ELSE 1 - lo END) AS value FROM cells, b"))
def log_transform(spark, sf_dir):
    return rounded(G.log_scaled(V.cells(spark, sf_dir)))


@query(f"WITH {CELLS}, b AS (SELECT min(value) AS lo FROM cells) " + layer("SELECT lati, loni, sqrt(value - lo) AS value FROM cells, b"))
def sqrt_transform(spark, sf_dir):
    return rounded(G.sqrt_scaled(V.cells(spark, sf_dir)))


@query(f"WITH {CELLS} " + layer("SELECT CAST(lati // 3 AS INTEGER) AS lati, CAST(loni // 3 AS INTEGER) AS loni, avg(value) AS value FROM cells GROUP BY ALL"))
def shrink_mean(spark, sf_dir):
    return rounded(G.shrunk(V.cells(spark, sf_dir), 3, "mean"))


@query(f"""WITH {REGIONS}, c AS (SELECT CAST(lati // 3 AS INTEGER) AS lati, CAST(loni // 3 AS INTEGER) AS loni, value, count(*) AS n FROM regions GROUP BY ALL)
    SELECT lati, loni, arg_max(value, (n, -value)) AS value FROM c GROUP BY ALL""")
def shrink_mode(spark, sf_dir):
    return G.shrunk(V.regions(spark, sf_dir), 3, "mode")


@query(f"WITH {CELLS} SELECT CAST(lati // 2 AS INTEGER) AS lati, CAST(loni // 2 AS INTEGER) AS loni, CASE WHEN sum((value > 4500)::INT) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM cells GROUP BY ALL")
def shrink_binary(spark, sf_dir):
    flags = V.cells(spark, sf_dir).withColumn("value", (F.col("value") > 4500).cast("double"))
    return G.shrunk(flags, 2, "binary")


@query(f"WITH {CELLS} " + layer("SELECT c.lati, c.loni, max((n.value > 8000)::INT)::DOUBLE AS value FROM cells c JOIN cells n ON abs(c.lati - n.lati) <= 1 AND abs(c.loni - n.loni) <= 1 GROUP BY ALL"))
def dilate3x3(spark, sf_dir):
    flags = V.cells(spark, sf_dir).withColumn("value", (F.col("value") > 8000).cast("double"))
    return G.dilated(flags)


SIDES = "abs(a.lati - b.lati) + abs(a.loni - b.loni) = 1"


@query(f"WITH {REGIONS} SELECT a.lati, a.loni, coalesce(max((a.value <> b.value)::INT), 0)::DOUBLE AS value FROM regions a LEFT JOIN regions b ON {SIDES} GROUP BY ALL")
def boundary(spark, sf_dir):
    return G.boundary(V.regions(spark, sf_dir))


@query(f"WITH {REGIONS} SELECT a.value AS a, b.value AS b, count(*) AS sides FROM regions a JOIN regions b ON {SIDES} AND a.value <> b.value GROUP BY ALL")
def adjacency(spark, sf_dir):
    return G.adjacency(V.regions(spark, sf_dir))


@query(f"WITH {REGIONS} SELECT value AS region, round(-34.5::DOUBLE + (avg(lati) + 0.5) * (1.5::DOUBLE / 40), 11) AS lat, round(150.0::DOUBLE + (avg(loni) + 0.5) * (1.7::DOUBLE / 40), 11) AS lon FROM regions GROUP BY 1")
def centroids(spark, sf_dir):
    return rounded(G.centroids(V.regions(spark, sf_dir), GRID), 11)


@query(f"""WITH {REGIONS} SELECT value AS region, count(*) AS cells, round(count(*) * radians(1.5::DOUBLE / 40) * 6372.795::DOUBLE * radians(1.7::DOUBLE / 40) * 6372.795::DOUBLE * cos(radians(-33.75::DOUBLE)), 4) AS km2
    FROM regions GROUP BY 1""")
def areas(spark, sf_dir):
    return rounded(G.areas(V.regions(spark, sf_dir), GRID), 4)


@query(f"WITH {REGIONS} SELECT DISTINCT value FROM regions WHERE value >= 0")
def distinct_values(spark, sf_dir):
    return G.distinct_values(V.regions(spark, sf_dir))


@query(f"""WITH {CELLS}, {OTHER} SELECT coalesce(c.lati, o.lati) AS lati, coalesce(c.loni, o.loni) AS loni, greatest((coalesce(c.value, 0) > 9000)::INT, (coalesce(o.value, 0) > 300000)::INT)::DOUBLE AS value
    FROM cells c FULL JOIN other o ON c.lati = o.lati AND c.loni = o.loni""")
def union_binary(spark, sf_dir):
    flag = lambda df, t: df.withColumn("value", (F.col("value") > t).cast("double"))
    return G.union_binary(flag(V.cells(spark, sf_dir), 9000), flag(V.other(spark, sf_dir), 300000))


@query(f"WITH {POINTS} SELECT {LATI} AS lati, {LONI} AS loni, round(avg(value), 6) AS value FROM points GROUP BY ALL")
def rasterised(spark, sf_dir):
    return rounded(G.rasterised(V.points(spark, sf_dir), GRID, "value"))


@query(f"WITH {CELLS} SELECT lati, loni, value FROM cells ORDER BY value DESC, lati, loni LIMIT 1")
def best_cell(spark, sf_dir):
    return G.best_cell(V.cells(spark, sf_dir))


DY, DX = "(radians(1.5::DOUBLE / 40) * 6372795.0::DOUBLE)", "(radians(1.7::DOUBLE / 40) * 6372795.0::DOUBLE * cos(radians(-34.5::DOUBLE)))"


@query(f"""WITH {CELLS}, s AS (SELECT i, j, 1 / pow(greatest(d, 500) / 1000, 2) AS w FROM (SELECT i, j, sqrt(pow(i * {DY}, 2) + pow(j * {DX}, 2)) AS d FROM range(-3, 4) a(i), range(-3, 4) b(j)) WHERE d <= 9000)
    SELECT c.lati, c.loni, round(sum(n.value * w), 4) + 0.0::DOUBLE AS value FROM cells c CROSS JOIN s JOIN cells n ON n.lati = c.lati + i AND n.loni = c.loni + j GROUP BY ALL""")
def decay_focal(spark, sf_dir):
    return rounded(G.decay_sum(V.cells(spark, sf_dir), GRID, 9000, 500), 4)


@query(f"""WITH {CELLS}, f AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i >= 40 OR j >= 40 THEN -1 WHEN value > 4500 THEN 1 ELSE 0 END::DOUBLE AS v FROM range(64) a(i) CROSS JOIN range(64) b(j) LEFT JOIN cells ON lati = i AND loni = j),
    u AS (SELECT CAST(d AS INTEGER) AS depth, i >> (6 - d) AS lati, j >> (6 - d) AS loni, min(v) AS value FROM f, range(7) t(d) GROUP BY ALL HAVING min(v) = max(v))
    SELECT depth, lati, loni, value FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.depth = u.depth - 1 AND p.lati = u.lati >> 1 AND p.loni = u.loni >> 1)""")
def quadtree_cover(spark, sf_dir):
    """Blocks of the quadtree of rich cells: the 40 x 40 cells in a grid of 64 x 64, whose rest is -1."""
    rich = V.cells(spark, sf_dir).select("lati", "loni", (F.col("value") > 4500).cast("double").alias("rich"))
    places = spark.range(64 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("lati"), (F.col("id") % 64).cast("int").alias("loni"))
    value = F.when((F.col("lati") >= 40) | (F.col("loni") >= 40), -1.0).otherwise(F.coalesce("rich", F.lit(0.0)))
    return G.quadtree(places.join(rich, ["lati", "loni"], "left").select("lati", "loni", value.alias("value")), 6)
