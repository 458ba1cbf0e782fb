"""Queries of trees and forests that grow by hashed draws, so that SQL can grow the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import colours as C
from lithos.operators import forest as R
from lithos.operators import trees as G
from lithos.plans.registry import query
from lithos.plans.views import rounded, table
from lithos.scratch import Scratch


def _hash(*parts) -> str:
    return f"substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 12)"


def _uniform(*parts) -> str:
    return f"((CAST('0x' || {_hash(*parts)} AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def grown_sql(rows: str, features: int, trees: int, tries: int, capacity: int, levels: int, seed: int) -> str:
    """Blocks of WITH: r0 to r<levels> are the rows before each level and at the end, b<k> the splits of level k."""
    weight = "1" if trees == 1 else " + ".join(f"CASE WHEN u >= {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in G.poisson_steps())
    bag = _uniform(seed, "'bag'", "tree", "id")
    blocks = [f"r0 AS MATERIALIZED (SELECT tree, id, {weight} AS w, x, y, 1::BIGINT AS node FROM (SELECT *, {bag} AS u FROM ({rows}), range({trees}) t(tree)))"]
    for k in range(levels):
        feature = f"CAST(floor({_uniform(seed, quote('feature'), 'tree', 'node', 'k')} * {features}) AS INTEGER)"
        at = lambda side: f"arg_min(x[f + 1], {_hash(seed, quote('row'), 'tree', 'node', 'k', side, 'id')})"  # noqa: E731, B023
        blocks += [
            f"o{k} AS (SELECT tree, node, k, {feature} AS f FROM (SELECT tree, node FROM r{k} GROUP BY ALL HAVING sum(w) > {capacity}), range({tries}) t(k))",
            f"c{k} AS MATERIALIZED (SELECT tree, node, k, f, a + {_uniform(seed, quote('split'), 'tree', 'node', 'k')} * (b - a) AS split FROM (SELECT tree, node, k, f, {at(0)} AS a, {at(1)} AS b FROM r{k} JOIN o{k} USING (tree, node) WHERE w > 0 GROUP BY tree, node, k, f))",
            f"e{k} AS (SELECT tree, node, k, f, split, x[f + 1] >= split AS side, sum(w) AS n, greatest(sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w), 0) AS e FROM r{k} JOIN c{k} USING (tree, node) WHERE w > 0 GROUP BY ALL)",
            f"b{k} AS MATERIALIZED (SELECT tree, node, arg_min(f, (e, k)) AS f, arg_min(split, (e, k)) AS split FROM (SELECT tree, node, k, f, split, sum(e) AS e FROM e{k} GROUP BY ALL HAVING count(*) = 2 AND min(n) >= sum(n) / 16) GROUP BY ALL)",
            f"r{k + 1} AS MATERIALIZED (SELECT tree, id, w, x, y, CASE WHEN f IS NULL THEN node ELSE 2 * node + CASE WHEN x[f + 1] >= split THEN 1 ELSE 0 END END AS node FROM r{k} LEFT JOIN b{k} USING (tree, node))",
        ]
    return ", ".join(blocks)


def quote(x: str) -> str:
    return f"'{x}'"


ORDERS = "SELECT o_orderkey AS id, [o_custkey::DOUBLE, month(o_orderdate)::DOUBLE, (o_orderkey % 100)::DOUBLE] AS x, o_totalprice::DOUBLE AS y FROM orders"


@query(f"""WITH {grown_sql(ORDERS, 3, 1, 3, 500, 3, 5)}, s AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)
    SELECT CAST(tree AS INTEGER) AS tree, node, CAST(sum(w) AS BIGINT) AS n, round(sum(w * y) / sum(w), 7) AS mean, NULL::INTEGER AS feature, NULL::DOUBLE AS split FROM r3 GROUP BY tree, node
    UNION ALL SELECT CAST(tree AS INTEGER), node, NULL, NULL, CAST(f AS INTEGER), split FROM s""")
def grown_tree(spark, sf_dir):
    """A tree of three levels for prices of orders by customer, month and the end of their key: its splits and leaves."""
    features = F.col("o_custkey"), F.month("o_orderdate"), F.col("o_orderkey") % 100
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(*(c.cast("double") for c in features)).alias("x"), F.col("o_totalprice").alias("y"))
    nodes, _ = G.grown(rows, 3, tries=3, capacity=500, levels=3, seed=5)
    return nodes.withColumn("mean", F.round("mean", 7))


#: Sevenths of prices, because means of a few cents may end right where they are rounded.
PARTS = "SELECT p_partkey AS id, [p_size::DOUBLE, (p_partkey % 100)::DOUBLE] AS x, p_retailprice::DOUBLE / 7 AS y FROM part"


def _forest(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double")).alias("x"), (F.col("p_retailprice").cast("double") / 7).alias("y"))
    return G.out_of_bag(*G.grown(rows, 2, trees=30, tries=3, capacity=20, levels=3, seed=7))


OUT = f"""{grown_sql(PARTS, 2, 30, 3, 20, 3, 7)}, m AS (SELECT tree, node, sum(w * y) / sum(w) AS mean FROM r3 WHERE w > 0 GROUP BY ALL),
    oob AS (SELECT id, tree, y, mean FROM r3 JOIN m USING (tree, node) WHERE w = 0)"""


@query(f"""WITH {OUT} SELECT id, round(avg(mean), 7) AS mean, round(median(mean), 7) AS median, count(*) AS trees,
    CASE WHEN count(*) >= 8 THEN round(quantile_cont(mean, 0.125), 7) END AS lo_75, CASE WHEN count(*) >= 8 THEN round(quantile_cont(mean, 0.875), 7) END AS hi_75,
    CASE WHEN count(*) >= 20 THEN round(quantile_cont(mean, 0.05), 7) END AS lo_90, CASE WHEN count(*) >= 20 THEN round(quantile_cont(mean, 0.95), 7) END AS hi_90,
    CASE WHEN count(*) >= 40 THEN round(quantile_cont(mean, 0.025), 7) END AS lo_95, CASE WHEN count(*) >= 40 THEN round(quantile_cont(mean, 0.975), 7) END AS hi_95 FROM oob GROUP BY id""")
def out_of_bag_bounds(spark, sf_dir):
    """What the trees of a forest that have not seen a part say about its price, and within what bounds."""
    return rounded(R.out_of_bag_bounds(_forest(spark, sf_dir), "id"), 7)


@query(f"""WITH {OUT}, p AS (SELECT id, any_value(y) AS y, avg(mean) AS p FROM oob GROUP BY id), e AS (SELECT y - p AS e FROM p), l AS (SELECT min(e) AS lo, max(e) AS hi FROM e)
    SELECT CAST(least(floor((e - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS cnt FROM e, l GROUP BY 1""")
def out_of_bag_errors(spark, sf_dir):
    """How far a forest's out-of-bag means are off: ten bins from the least to the largest error."""
    errors = _forest(spark, sf_dir).groupBy("id").agg((F.first("y") - F.avg("prediction")).alias("e"))
    low, high = errors.agg(F.min("e"), F.max("e")).first()
    if low is None:
        return errors.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("cnt"))
    at = F.least(F.floor((F.col("e") - low) / ((high - low) / 10)), F.lit(9)).cast("int")
    return errors.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


@query("""WITH c AS (SELECT p_brand, p_size // 10 AS cls, count(*) AS n FROM part GROUP BY ALL) SELECT CAST(sum(e) AS BIGINT) AS errors FROM (SELECT sum(n) - max(n) AS e FROM c GROUP BY p_brand)""")
def leaf_errors(spark, sf_dir):
    """Parts that aren't of the commonest size class of their brand."""
    return R.leaf_error(table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_size") / 10).alias("cls")), "p_brand", "cls")


@query("""WITH s AS (SELECT o_totalprice AS y, o_custkey < 500 AS side FROM orders), m AS (SELECT *, avg(y) OVER (PARTITION BY side) AS m FROM s) SELECT round(sum(pow(abs(y - m), 1.5::DOUBLE)), 0) AS error FROM m""")
def split_error(spark, sf_dir):
    """Sum of |residual| ** 1.5 about the means of both sides of a split of orders."""
    return rounded(R.split_error(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 500, 1.5), 0)


COLOURS = [(0.0, 50.0), (0.0, 100.0), (900.0, 2000.0)]


def coloured_sql(rows: str, trees: int, depth: int, seed: int) -> str:
    """Blocks of WITH: w<depth> has every row of `rows` (id, x, cls) once a tree with its way, nodes the counts of prefixes."""
    low, high = (f"[{', '.join(f'{b[k]!r}::DOUBLE' for b in COLOURS)}]" for k in (0, 1))
    blocks = [f"w0 AS (SELECT id, x, cls, tree, '' AS way, {low} AS low, {high} AS high FROM ({rows}), range({trees}) t(tree))"]
    for k in range(depth):
        axis, place = (_uniform(seed, quote(x), "tree", "way") for x in ("axis", "place"))
        step = f"SELECT *, low[a] + u * (high[a] - low[a]) AS cut FROM (SELECT *, CAST(floor({axis} * 3) AS INTEGER) + 1 AS a, {place} AS u FROM w{k})"
        side = lambda c, take: f"list_transform({c}, lambda v, i: CASE WHEN i = a AND {take} THEN cut ELSE v END) AS {c}"
        blocks.append(f"w{k + 1} AS (SELECT id, x, cls, tree, way || CASE WHEN x[a] >= cut THEN '1' ELSE '0' END AS way, {side('low', 'x[a] >= cut')}, {side('high', 'x[a] < cut')} FROM ({step}))")
    blocks.append(f"nodes AS MATERIALIZED (SELECT tree, substr(way, 1, k) AS node, cls, count(*) AS n FROM w{depth}, range({depth + 1}) r(k) GROUP BY ALL)")
    return ", ".join(blocks)


COLOURED = coloured_sql("SELECT p_partkey AS id, [p_size::DOUBLE, (p_partkey % 100)::DOUBLE, p_retailprice::DOUBLE] AS x, p_brand AS cls FROM part", 3, 6, 11)


def _coloured(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double"), F.col("p_retailprice").cast("double")).alias("x"), F.col("p_brand").alias("cls"))


@query(f"WITH {COLOURED} SELECT CAST(tree AS INTEGER) AS tree, node, cls, n FROM nodes")
def colour_counts(spark, sf_dir):
    """Brands of parts by the nodes of random partitions of size, end of key and price."""
    return C.counted(_coloured(spark, sf_dir), COLOURS, 3, 6, 11)


@query(f"""WITH {COLOURED}, d AS (SELECT id, tree, way AS node FROM w6), s AS (SELECT tree, node, cls, n / sum(n) OVER (PARTITION BY tree, node) AS share FROM nodes),
    v AS (SELECT id, cls, sum(share) / 3 AS share FROM d JOIN s USING (tree, node) GROUP BY ALL), b AS (SELECT id, max(share) AS best FROM v GROUP BY 1)
    SELECT id, min(cls) AS cls, round(max(best), 9) AS share FROM v JOIN b USING (id) WHERE abs(share - best) < 1e-9 GROUP BY id""")
def coloured_parts(spark, sf_dir):
    """The brand that three partition trees give to each part."""
    rows = _coloured(spark, sf_dir)
    counts = Scratch(spark, "colours").save(C.counted(rows, COLOURS, 3, 6, 11))
    return rounded(C.classified(rows.select("id", "x"), counts, COLOURS, 3, 6, 11), 9)
