"""The tables as the concepts of this engine: the places, layers, bars and networks that queries run on.

No table has coordinates, so they are derived from keys by integer arithmetic. Each view stands here as a DataFrame and as
an oracle's common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.maths import round_scaled
from lithos.operators.grid import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Every view lies in this box; rasters have 40 x 40 cells.
GRID = Grid(-34.5, 150.0, 1.5, 1.7, 40, 40)

POINTS = """points AS (SELECT c_custkey AS id, -34.5::DOUBLE + (c_custkey % 150) * 0.01::DOUBLE AS lat, 150.0::DOUBLE + ((c_custkey * 7) % 170) * 0.01::DOUBLE AS lon,
    c_acctbal AS value, c_nationkey AS nation FROM customer)"""
SITES = """sites AS (SELECT s_suppkey AS site, -34.5::DOUBLE + ((s_suppkey * 13) % 150) * 0.01::DOUBLE AS lat, 150.0::DOUBLE + ((s_suppkey * 29) % 170) * 0.01::DOUBLE AS lon,
    s_acctbal AS v, s_nationkey AS nation FROM supplier)"""
CELLS = """cells AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS lati, CAST((c_custkey // 40) % 40 AS INTEGER) AS loni, avg(c_acctbal) AS value FROM customer GROUP BY ALL)"""
OTHER = """other AS (SELECT CAST(o_custkey % 40 AS INTEGER) AS lati, CAST((o_custkey // 40) % 40 AS INTEGER) AS loni, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"""
REGIONS = """regions AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS lati, CAST((c_custkey // 40) % 40 AS INTEGER) AS loni, max(c_nationkey) AS value FROM customer GROUP BY ALL)"""
BARS = """bars AS (SELECT CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    count(value) AS volume FROM events GROUP BY 1)"""
FLOWS = """flows AS (SELECT c_nationkey AS r1, s_nationkey AS r2, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
DISTANCE = """2 * 6372795.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({a}.lat) - radians({b}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({a}.lon) - radians({b}.lon)) / 2), 2))))"""


def distance(a: str, b: str) -> str:
    return DISTANCE.format(a=a, b=b)


def points(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), (F.lit(-34.5) + (k % 150) * F.lit(0.01)).alias("lat"), (F.lit(150.0) + ((k * 7) % 170) * F.lit(0.01)).alias("lon"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation"))


def sites(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("site"), (F.lit(-34.5) + ((k * 13) % 150) * F.lit(0.01)).alias("lat"), (F.lit(150.0) + ((k * 29) % 170) * F.lit(0.01)).alias("lon"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("nation"))


def _cells(df: DataFrame, key: str, value) -> DataFrame:
    k = F.col(key)
    return df.groupBy((k % 40).cast("int").alias("lati"), (F.floor(k / 40) % 40).cast("int").alias("loni")).agg(value.alias("value"))


def cells(spark, sf_dir) -> DataFrame:
    return _cells(table(spark, sf_dir, "customer"), "c_custkey", F.avg("c_acctbal"))


def other(spark, sf_dir) -> DataFrame:
    return _cells(table(spark, sf_dir, "orders"), "o_custkey", F.avg("o_totalprice"))


def regions(spark, sf_dir) -> DataFrame:
    return _cells(table(spark, sf_dir, "customer"), "c_custkey", F.max("c_nationkey"))


def bars(spark, sf_dir) -> DataFrame:
    from lithos.operators.timeseries import bars as of

    return of(table(spark, sf_dir, "events"), F.to_date("ts"), "value", "ts", "event_id")


def flows(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("r1"), F.col("s_nationkey").alias("r2")).agg(F.count(F.lit(1)).alias("n"))


def rounded(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    """Doubles rounded, because engines add in another order; minus zero made zero."""
    return df.select(*((round_scaled(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))
