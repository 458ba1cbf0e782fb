"""Queries of binary rasters and of the region store: both are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.plans import views as V
from lithos.plans.rasters import LATI, LONI
from lithos.plans.registry import query
from lithos.plans.views import CELLS, GRID, POINTS, REGIONS, rounded, table
from lithos.scratch import Scratch
from lithos.sources import gis, sinks
from lithos.sources.store import Store

EVERY = "every AS (SELECT CAST(i AS INTEGER) AS lati, CAST(j AS INTEGER) AS loni FROM range(40) a(i), range(40) b(j))"


def _written(spark, cells, kind: str, name: str = "layer", categories=None) -> str:
    """The folder with a raster file of `cells`, in bands of five rows."""
    path = f"{Scratch(spark, 'gis').root}/gis"
    gis.write_cells(cells.select(F.lit(name).alias("layer"), "lati", "loni", "value"), GRID, kind, path, categories, 200)
    return path


@query(f"WITH {CELLS}, {EVERY} SELECT 'layer' AS layer, lati, loni, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM every LEFT JOIN cells USING (lati, loni)")
def raster_file(spark, sf_dir):
    """Mean balances by cell as 32-bit numbers; cells without customers have no value."""
    return gis.read_cells(spark, _written(spark, V.cells(spark, sf_dir), "CONTINUOUS"))


@query(f"WITH {CELLS} SELECT lati, loni, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cells WHERE lati BETWEEN 12 AND 21 AND loni > 7 AND loni <= 30 AND CAST(value AS FLOAT) > 1000")
def raster_window(spark, sf_dir):
    """A window of a raster file: of its eight bands three are read."""
    found = gis.read_cells(spark, _written(spark, V.cells(spark, sf_dir), "CONTINUOUS"))
    return found.where("lati BETWEEN 12 AND 21 AND loni > 7 AND loni <= 30 AND value > 1000").select("lati", "loni", "value")


@query(f"WITH {REGIONS}, {EVERY} SELECT lati, loni, regions.value::DOUBLE AS value FROM every LEFT JOIN regions USING (lati, loni)")
def category_raster_file(spark, sf_dir):
    return gis.read_cells(spark, _written(spark, V.regions(spark, sf_dir), "CATEGORICAL")).select("lati", "loni", "value")


@query(f"WITH {CELLS}, {EVERY} SELECT lati, loni, CASE WHEN value > 4000 THEN 1 ELSE 0 END::DOUBLE AS value FROM every LEFT JOIN cells USING (lati, loni)")
def binary_raster_file(spark, sf_dir):
    rich = V.cells(spark, sf_dir).withColumn("value", (F.col("value") > 4000).cast("int"))
    return gis.read_cells(spark, _written(spark, rich, "BINARY")).select("lati", "loni", "value")


def _store(spark, sf_dir) -> Store:
    """Nations as regions, with a table of balances, one of titles and one of customers, a raster, and settings."""
    root = Scratch(spark, "store").root
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    names = nations.select(F.lit("membership").alias("layer"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("category"))
    gis.write_cells(V.regions(spark, sf_dir).select(F.lit("membership").alias("layer"), "lati", "loni", "value"), GRID, "CATEGORICAL", f"{root}/gis/nations", names, 200)
    gis.write_cells(V.other(spark, sf_dir).select(F.lit("prices").alias("layer"), "lati", "loni", "value"), GRID, "CONTINUOUS", f"{root}/gis", None, 200)
    by_nation = customers.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("n")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.write_lines(by_nation.where("n_nationkey % 7 <> 3").select(F.concat_ws(" ", "n_name", "balance").alias("value")), f"{root}/gis/nations/money/balance.tab")
    sinks.write_lines(by_nation.select(F.concat_ws(",", "n_name", "n").alias("value")), f"{root}/gis/nations/customers.csv")
    sinks.write_lines(nations.select(F.concat(F.col("n_name"), F.lit(' "the nation '), "n_nationkey", F.lit('"')).alias("value")), f"{root}/gis/nations/title.tab")
    sinks.write_lines(customers.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.concat(F.lit("segment_"), F.translate("c_mktsegment", " ", "_")), "n").alias("value")), f"{root}/globals")
    return Store(spark, root)


@query(f"""WITH {POINTS}, {REGIONS}, b AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer WHERE c_nationkey % 7 <> 3 GROUP BY 1), p AS (SELECT *, {LATI} AS lati, {LONI} AS loni FROM points)
    SELECT id, n_name AS region, round(v, 6) AS balance FROM p LEFT JOIN regions r USING (lati, loni) LEFT JOIN nation ON n_nationkey = r.value LEFT JOIN b ON k = r.value""")
def store_values_at(spark, sf_dir):
    """Each point's region, and the value that a table of the store has for it."""
    found = _store(spark, sf_dir).values_at("nations", "money/balance", V.points(spark, sf_dir).select("id", "lat", "lon"))
    return rounded(found.select("id", "region", F.col("value_double").alias("balance")))


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT DISTINCT p_size AS z FROM part),
    q AS (SELECT 'nations' AS layer, CASE WHEN c_custkey % 3 = 0 THEN 'customers' WHEN c_custkey % 3 = 1 THEN 'title' ELSE 'none' END AS "table", 'NATION_' || (c_custkey % 30) AS region, c_custkey AS id FROM customer)
    SELECT id, CASE WHEN "table" = 'none' THEN 'ERROR no nations/none' WHEN n_nationkey IS NULL THEN 'ERROR no ' || region WHEN "table" = 'title' THEN 'the nation ' || n_nationkey
        ELSE coalesce(CAST(n.n::DOUBLE AS VARCHAR), 'ERROR no ' || region) END AS answer
    FROM q LEFT JOIN nation ON n_name = region LEFT JOIN n ON k = n_nationkey""")
def store_answers(spark, sf_dir):
    """A request for a value from each customer: of tables that there are and aren't, and of regions."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.lit("nations").alias("layer"), F.when(k % 3 == 0, "customers").when(k % 3 == 1, "title").otherwise("none").alias("table"), F.concat(F.lit("NATION_"), k % 30).alias("region"), k.alias("id"))
    return _store(spark, sf_dir).answers(asked).select("id", "answer")


@query("""SELECT 'layer' AS kind, 'nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'raster', 'prices', 1600
    UNION ALL SELECT 'table', 'nations/customers', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'table', 'nations/money/balance', count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 7 <> 3
    UNION ALL SELECT 'table', 'nations/title', count(*) FROM nation UNION ALL SELECT 'global', 'segment_' || replace(c_mktsegment, ' ', '_'), count(*) FROM customer GROUP BY c_mktsegment""")
def store_catalog(spark, sf_dir):
    """What a store holds: layers with the number of their regions, rasters with that of cells, tables of rows, settings."""
    s = _store(spark, sf_dir)
    s.check()
    parts = (
        s.layers().select(F.lit("layer").alias("kind"), F.col("layer").alias("name"), F.size("categories").cast("long").alias("n")),
        s.rasters().select(F.lit("raster"), "layer", F.col("latsteps").cast("long") * F.col("lonsteps")),
        s.tables.groupBy("layer", "table").agg(F.count(F.lit(1)).alias("n")).select(F.lit("table"), F.concat_ws("/", "layer", "table"), "n"),
        s.settings().select(F.lit("global"), "key", F.col("value").cast("long")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""WITH {REGIONS}, {V.OTHER} SELECT n_name AS region, count(*) AS cells, round(avg(CAST(o.value AS FLOAT)::DOUBLE), 4) AS price
    FROM regions r JOIN nation ON n_nationkey = r.value LEFT JOIN other o USING (lati, loni) GROUP BY 1""")
def store_zonal_prices(spark, sf_dir):
    """Mean price of each region's cells: a raster of the store over the membership of a layer."""
    s = _store(spark, sf_dir)
    (_, member), (_, prices) = s.membership("nations"), s.raster("prices")
    both = member.where("value IS NOT NULL").withColumnRenamed("value", "id").join(prices, ["lati", "loni"])
    found = both.groupBy(F.col("id").cast("int").alias("id")).agg(F.count(F.lit(1)).alias("cells"), F.avg("value").alias("price"))
    return rounded(found.join(s.regions("nations"), "id").select("region", "cells", "price"), 4)
