"""Queries of readers and writers: tables are written in the formats of files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators import density as D
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.views import CELLS, FLOWS, GRID, rounded, table
from lithos.scratch import Scratch
from lithos.sources import sinks, text


def written(spark: SparkSession, rows: DataFrame, whole: bool = False) -> str:
    """The folder with the lines `value` of `rows`; `whole` is for formats whose line numbers count: one small file."""
    path = f"{Scratch(spark, 'files').root}/lines"
    sinks.write_lines(rows.coalesce(1) if whole else rows, path)
    return path


@query("SELECT c_custkey::DOUBLE AS id, c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer")
def vector_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"])
    return text.points(spark, written(spark, rows), ["id", "nation", "balance"])


@query("SELECT CAST(ps[1] AS INTEGER) AS a, CAST(ps[2] AS INTEGER) AS b FROM (SELECT [p_partkey, p_size] AS ps FROM part)")
def int_vector_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "part"), ["p_partkey", "p_size"])
    return text.int_vectors(spark, written(spark, rows)).select(F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


@query("SELECT l_orderkey::DOUBLE AS k, l_quantity::DOUBLE AS q, l_extendedprice AS label FROM lineitem")
def regression_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_extendedprice"])
    return text.regression(spark, written(spark, rows)).select(F.get("features", F.lit(0)).alias("k"), F.get("features", F.lit(1)).alias("q"), "label")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS lat, s_nationkey::DOUBLE AS lon FROM supplier")
def identified_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal", "s_nationkey"], sep="  ")
    return text.identified(spark, written(spark, rows), ["lat", "lon"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand FROM part")
def headered_file(spark, sf_dir):
    path = f"{Scratch(spark, 'files').root}/table"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).csv(path)
    return text.headered(spark, path)


@query("SELECT 'part ' || p_partkey || ' is ' || p_brand AS value FROM part WHERE p_partkey % 3 <> 0")
def comments_left_out(spark, sf_dir):
    said = F.concat(F.lit("part "), F.col("p_partkey"), F.lit(" is "), F.col("p_brand"))
    marked = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("")), F.lit("# "), said)).otherwise(said)
    return text.lines(spark, written(spark, table(spark, sf_dir, "part").select(marked.alias("value")))).select("value")


LAST_SETTING = "SELECT 'nation' || c_nationkey AS key, 'customer ' || max(c_custkey) AS value FROM customer GROUP BY c_nationkey"


@query(LAST_SETTING)
def settings_file(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy("c_custkey")
    return text.settings(spark, written(spark, c.select(F.concat(F.lit("nation"), "c_nationkey", F.lit("  customer "), "c_custkey").alias("value")), whole=True))


@query(LAST_SETTING)
def properties_file(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy("c_custkey")
    return text.properties(spark, written(spark, c.select(F.concat(F.lit("nation"), "c_nationkey", F.lit(" = customer "), "c_custkey").alias("value")), whole=True))


@query(f"WITH {CELLS} SELECT CAST(i AS INTEGER) AS lati, CAST(j AS INTEGER) AS loni, round(value, 6) AS value FROM range(40) a(i) CROSS JOIN range(40) b(j) LEFT JOIN cells ON lati = i AND loni = j")
def ascii_grid_file(spark, sf_dir):
    path = written(spark, sinks.ascii_grid_lines(V.cells(spark, sf_dir), GRID).orderBy("line"), whole=True)
    return rounded(text.ascii_grid(spark, path))


@query(f"WITH {CELLS} SELECT CAST(i AS INTEGER) AS lati, CAST(j AS INTEGER) AS loni, CASE WHEN value > 0 THEN (i * 40 + j) / 1024.0::DOUBLE ELSE 0 END AS p FROM range(40) a(i) CROSS JOIN range(40) b(j) LEFT JOIN cells ON lati = i AND loni = j")
def probability_grid_file(spark, sf_dir):
    p = F.when(F.col("value") > 0, (F.col("lati") * 40 + F.col("loni")) / 1024).otherwise(0.0)
    path = written(spark, sinks.probability_lines(V.cells(spark, sf_dir).select("lati", "loni", p.alias("p")), GRID).orderBy("line"), whole=True)
    return text.probability_grid(spark, path)


@query("SELECT l_quantity::DOUBLE AS a, l_discount AS b, l_orderkey AS t, l_extendedprice AS misfit FROM lineitem")
def model_log_file(spark, sf_dir):
    models = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), "l_discount").alias("params"), F.col("l_orderkey").alias("t"), F.col("l_extendedprice").alias("misfit"))
    return text.model_log(spark, written(spark, sinks.model_lines(models))).select(F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "t", "misfit")


@query("SELECT l_quantity::DOUBLE AS a, l_discount AS b, l_extendedprice AS misfit FROM lineitem")
def models_by_width_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return text.models_by_width(spark, written(spark, rows), 2).select(F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "misfit")


@query(f"WITH {FLOWS} SELECT r1, r2, n::DOUBLE AS w FROM flows")
def mapping_file(spark, sf_dir):
    rows = sinks.mapping_lines(V.flows(spark, sf_dir).select("r1", "r2", F.col("n").cast("double").alias("w")))
    return text.weighted_mapping(spark, written(spark, rows)).select(F.col("r1").cast("int").alias("r1"), F.col("r2").cast("int").alias("r2"), "w")


@query(f"WITH {FLOWS} SELECT CAST(r1 AS VARCHAR) AS src, CAST(r2 AS VARCHAR) AS dst, n::DOUBLE AS w FROM flows")
def graph_file(spark, sf_dir):
    flows = V.flows(spark, sf_dir)
    near = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "r2", "n"))), " ")
    return text.graph(spark, written(spark, flows.groupBy("r1").agg(F.concat_ws(" ", F.col("r1"), near).alias("value"))))


@query("SELECT CAST(dim AS INTEGER) AS dim, CAST(bin AS INTEGER) AS bin, count(*) AS cnt FROM (SELECT 0 AS dim, least(floor(l_discount * 100 + 0.5), 10) AS bin FROM lineitem) GROUP BY ALL")
def density_file(spark, sf_dir):
    """A histogram of discounts by hundredths, as density text."""
    models = table(spark, sf_dir, "lineitem").select(F.array(F.least(F.floor(F.col("l_discount") * 100 + 0.5), F.lit(10)).cast("double")).alias("params"))
    hist = D.marginals(models, [(-0.5, 10.5)], 11)
    head = spark.createDataFrame([(-1, "0: -0.5 ... 10.5")], "dim int, value string")
    rows = head.unionByName(sinks.density_lines(hist)).orderBy("dim")
    return text.density_file(spark, written(spark, rows, whole=True)).where("cnt > 0").select(F.col("dim").cast("int").alias("dim"), F.col("bin").cast("int").alias("bin"), F.col("cnt").cast("long").alias("cnt"))


@query(f"""WITH {V.BARS}, n AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS m FROM bars)
    SELECT CAST(i - 2 AS INTEGER) AS idx, d, open, high, low, close, volume, close AS adjclose FROM n WHERE i >= 2 AND i < m - 1""")
def stock_file(spark, sf_dir):
    """Bars as lines of a price history, of which the first two and the last are left out."""
    said = F.concat_ws(" ", F.date_format("d", "d MMM yy"), "open", "high", "low", "close", F.format_number("volume", 0), "close")
    return text.stock_bars(spark, written(spark, V.bars(spark, sf_dir).orderBy("d").select(said.alias("value")), whole=True)).select("idx", "d", "open", "high", "low", "close", "volume", "adjclose")


@query("SELECT o_orderkey AS orig, o_custkey AS dest, o_totalprice AS time FROM orders")
def skim_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_orderkey", "o_custkey", *map(F.lit, "abcd"), "o_totalprice", F.lit("z")).alias("value"))
    short = spark.createDataFrame([("1 2 3",)], "value string")
    return text.skims(spark, written(spark, o.union(short)), 6)


@query("SELECT CAST(s_nationkey AS VARCHAR) AS postcode, array_to_string(list_sort(list(DISTINCT lower(replace(s_name, ' ', '_')))), ',') AS suburbs FROM supplier GROUP BY 1")
def postcode_file(spark, sf_dir):
    rows = sinks.table_lines(table(spark, sf_dir, "supplier"), ["s_nationkey", "s_name"], sep=",")
    return text.postcodes(spark, written(spark, rows)).withColumn("suburbs", F.array_join("suburbs", ","))


@query("SELECT 'nation_' || n_nationkey AS name, n_nationkey * 0.5::DOUBLE AS south, n_nationkey * 0.5::DOUBLE + 1 AS north, 100.0::DOUBLE + n_nationkey AS west, 101.5::DOUBLE + n_nationkey AS east FROM nation")
def kml_polygon_file(spark, sf_dir):
    """A box for each nation as a KML polygon; the bounds of what is read back."""
    k = F.col("n_nationkey")
    corner = lambda a, b: F.struct((k * 0.5 + a).alias("lat"), (k + 100.0 + b).alias("lon"))
    rings = table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation "), k).alias("name"), F.array(corner(0, 0), corner(0, 1.5), corner(1, 1.5), corner(1, 0), corner(0, 0)).alias("ring"))
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    marks = sinks.polygons(rings).select(F.explode(F.split(F.replace("value", F.lit("><"), F.lit(">\n<")), "\n")).alias("value"))
    found = text.kml_polygons(spark, written(spark, line(sinks.HEADER).union(marks).union(line(sinks.FOOTER)), whole=True))
    side = lambda f, x: f(F.transform("ring", lambda p: p[x]))
    return found.select("name", side(F.array_min, "lat").alias("south"), side(F.array_max, "lat").alias("north"), side(F.array_min, "lon").alias("west"), side(F.array_max, "lon").alias("east"))
