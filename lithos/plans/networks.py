"""Queries of graphs and of trips between zones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithos.operators import graph as N
from lithos.operators import stats as S
from lithos.operators import trajectory as TR
from lithos.operators import transport as T
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.views import FLOWS, rounded, table
from lithos.scratch import Scratch

#: Edges between nations that trade with each other: whole numbers, so that sums are exact.
EDGES = f"{FLOWS}, edges AS (SELECT r1 AS src, r2 AS dst, CAST(1 + (1000 // n) AS DOUBLE) AS w FROM flows WHERE r1 <> r2)"
PATHS = f"""{EDGES}, walk(origin, node, dist, hops) AS (SELECT DISTINCT src, src, 0.0::DOUBLE, 0 FROM edges UNION ALL
    SELECT origin, e.dst, min(p.dist + e.w), p.hops + 1 FROM walk p JOIN edges e ON p.node = e.src WHERE p.hops < 24 GROUP BY origin, e.dst, p.hops), best AS (SELECT origin, node, min(dist) AS dist, arg_min(hops, (dist, hops)) AS hops FROM walk GROUP BY ALL)"""


def _edges(spark, sf_dir):
    f = V.flows(spark, sf_dir).where("r1 <> r2")
    return f.select(F.col("r1").alias("src"), F.col("r2").alias("dst"), (1 + F.floor(F.lit(1000) / F.col("n"))).cast("double").alias("w"))


@query(f"WITH RECURSIVE {PATHS} SELECT origin, node, dist FROM best")
def shortest_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return N.shortest_paths(edges, edges.select("src")).select("origin", "node", "dist")


@query(f"WITH RECURSIVE {PATHS} SELECT a.origin, a.node AS dest, a.dist * 0.5 AS cost, b.dist * 0.5 AS back FROM best a LEFT JOIN best b ON a.origin = b.node AND a.node = b.origin")
def cost_matrix(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return N.cost_matrix(N.shortest_paths(edges, edges.select("src")), 0.5)


@query(f"WITH RECURSIVE {PATHS} SELECT origin, hops, count(*) AS nodes, max(dist) AS farthest FROM best GROUP BY ALL")
def path_lengths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return N.shortest_paths(edges, edges.select("src")).groupBy("origin", "hops").agg(F.count(F.lit(1)).alias("nodes"), F.max("dist").alias("farthest"))


@query(f"""WITH RECURSIVE {PATHS}, prev AS (SELECT b.origin, b.node, min(e.src) AS prev FROM best b JOIN best a ON a.origin = b.origin JOIN edges e ON e.src = a.node AND e.dst = b.node
        WHERE a.dist + e.w = b.dist AND a.hops + 1 = b.hops GROUP BY ALL),
    climb AS (SELECT r1 AS origin, r2 AS node, n FROM flows UNION ALL SELECT c.origin, p.prev, c.n FROM climb c JOIN prev p ON p.origin = c.origin AND p.node = c.node)
    SELECT p.prev AS src, p.node AS dst, sum(c.n)::DOUBLE AS trips, any_value(e.w) AS w, sum(c.n)::DOUBLE * any_value(e.w) AS work
    FROM climb c JOIN prev p ON p.origin = c.origin AND p.node = c.node JOIN edges e ON e.src = p.prev AND e.dst = p.node GROUP BY ALL""")
def edge_loads(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    paths = N.shortest_paths(edges, edges.select("src"))
    trips = V.flows(spark, sf_dir).select(F.col("r1").alias("origin"), F.col("r2").alias("dest"), F.col("n").alias("trips"))
    return N.edge_loads(paths, trips, edges)


@query()
def amalgamated_zones(spark, sf_dir):
    zones = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count(F.lit(1)).alias("cnt"), F.lit(1.0).alias("area"), F.avg("c_acctbal").alias("value"))
    links = _edges(spark, sf_dir).select("src", "dst")
    return N.amalgamated(zones, links.union(links.select("dst", "src")), 150, 5.0)


MODES = "m AS (SELECT s_nationkey AS zone, s_suppkey % 3 AS mode, avg(abs(s_acctbal)) / 1000 AS cost FROM supplier GROUP BY ALL)"


def _modes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone"), (F.col("s_suppkey") % 3).alias("mode")).agg((F.avg(F.abs("s_acctbal")) / 1000).alias("cost"))


@query(f"WITH {MODES} SELECT zone, mode, round(exp(-cost / 2) / sum(exp(-cost / 2)) OVER (PARTITION BY zone), 9) AS p FROM m")
def softmax_split(spark, sf_dir):
    return rounded(T.logit_split(_modes(spark, sf_dir), "zone", "cost", 2.0).select("zone", "mode", "p"), 9)


@query(f"""WITH {MODES}, n AS (SELECT *, (mode > 0)::INT AS nest FROM m), b AS (SELECT zone, nest, min(cost) AS c FROM n GROUP BY ALL), pb AS (SELECT zone, nest, exp(-c / 2) / sum(exp(-c / 2)) OVER (PARTITION BY zone) AS pn FROM b),
    po AS (SELECT *, exp(-cost) / sum(exp(-cost)) OVER (PARTITION BY zone, nest) AS po FROM n) SELECT zone, mode, round(pn * po, 9) AS p FROM po JOIN pb USING (zone, nest)""")
def nested_split(spark, sf_dir):
    m = _modes(spark, sf_dir).withColumn("nest", (F.col("mode") > 0).cast("int"))
    return rounded(T.nested_split(m, "zone", "nest", "mode", "cost", 2.0, 1.0).select("zone", "mode", "p"), 9)


MASS = "z AS (SELECT n_nationkey AS zone, coalesce(sum(abs(s_acctbal)), 1) AS mass FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1)"
OD = f"{MASS}, od AS (SELECT a.zone AS origin, b.zone AS dest, CAST(abs(a.zone - b.zone) + 1 AS DOUBLE) AS cost, b.mass AS activity, a.mass AS mass_o FROM z a CROSS JOIN z b)"


def _od(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    z = joined.groupBy(F.col("n_nationkey").alias("zone")).agg(F.coalesce(F.sum(F.abs("s_acctbal")), F.lit(1.0)).alias("mass"))
    a, b = z.select(F.col("zone").alias("origin"), F.col("mass").alias("mass_o")), z.select(F.col("zone").alias("dest"), F.col("mass").alias("activity"))
    return a.crossJoin(F.broadcast(b)).withColumn("cost", (F.abs(F.col("origin") - F.col("dest")) + 1).cast("double"))


@query(f"WITH {OD} SELECT origin, dest, round(activity * exp(-cost / 4) / sum(activity * exp(-cost / 4)) OVER (PARTITION BY origin), 9) AS p FROM od")
def gravity(spark, sf_dir):
    return rounded(T.gravity(_od(spark, sf_dir), 4.0).select("origin", "dest", "p"), 9)


@query(f"WITH {OD} SELECT origin, dest, round(mass_o * (activity / cost) / sum(activity / cost) OVER (PARTITION BY origin), 4) AS trips FROM od WHERE origin <> dest")
def gravity_invdist(spark, sf_dir):
    od = _od(spark, sf_dir).select("origin", "dest", F.col("cost").alias("dist"), "mass_o", F.col("activity").alias("mass_d"))
    return rounded(T.gravity_by_distance(od).select("origin", "dest", "trips"), 4)


@query(f"WITH {OD} SELECT origin, round(sum(CASE WHEN cost <= 3 THEN activity ELSE 0 END), 4) AS within_0, round(sum(CASE WHEN cost <= 8 THEN activity ELSE 0 END), 4) AS within_1 FROM od GROUP BY 1")
def within_budget(spark, sf_dir):
    return rounded(T.within_budget(_od(spark, sf_dir), [3.0, 8.0]), 4)


@query()
def destination_balance(spark, sf_dir):
    """How far the balanced trips of each destination are from their target: less than a tenth of it."""
    od = _od(spark, sf_dir).select("origin", "dest", F.col("mass_o").alias("trips"), (F.col("activity") * F.exp(-F.col("cost") / 4)).alias("w"))
    targets = od.groupBy("origin").agg(F.first("trips").alias("target")).withColumnRenamed("origin", "dest")
    done = T.balanced(od, targets)
    sums = done.groupBy("dest").agg(F.sum(F.col("trips") * F.col("p")).alias("actual")).join(targets, "dest")
    return sums.select("dest", (F.abs(F.col("actual") - F.col("target")) < F.col("target") * 0.12).alias("near"))


@query(f"""WITH {FLOWS}, d AS (SELECT r2 AS r1, r1 AS r2, n FROM flows) SELECT CAST(r1 AS INTEGER) AS r1, round(sum(least(f.n, coalesce(d.n, 0))) / sum(f.n), 9) AS satisfaction FROM flows f LEFT JOIN d USING (r1, r2) GROUP BY 1""")
def satisfaction_overlap(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    turned = f.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "n")
    out = T.overlap_satisfaction(f.withColumn("n", F.col("n").cast("double")), turned.withColumn("n", F.col("n").cast("double")), ["r1", "r2"], "n", "r1")
    return rounded(out, 9)


@query(f"""WITH RECURSIVE {MASS}, r(n, x, change) AS (SELECT 0, 2.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT n + 1, x - (x - 1) / (2 * (n + 2)), (x - 1) / (2 * (n + 2)) / x FROM r WHERE n < 12 AND NOT (n >= 4 AND n % 2 = 0 AND change < 0.02))
    SELECT zone AS origin, round(x, 6) AS ratio, n AS rounds FROM z, (SELECT * FROM r ORDER BY n DESC LIMIT 1)""")
def successive_averages(spark, sf_dir):
    """A fixed point that is known: each zone's load x answers with (x + its mass) / 2, so that it ends at the mass."""
    z = _od(spark, sf_dir).groupBy("origin").agg(F.first("mass_o").alias("mass"))
    respond = lambda t: t.join(z, "origin").select("origin", ((F.col("x") + F.col("mass")) / 2).alias("x"))
    done, n = T.successive_averages(z.select("origin", (F.col("mass") * 2).alias("x")), respond, ["origin"], "x")
    return done.join(z, "origin").select("origin", F.round(F.col("x") / F.col("mass"), 6).alias("ratio"), F.lit(n).alias("rounds"))


@query(f"WITH {MODES}, w AS (SELECT zone, mode, cost * 0.7::DOUBLE AS c FROM m UNION ALL SELECT zone, mode, 0.3::DOUBLE FROM m) SELECT zone, mode, round(sum(c), 9) AS cost FROM w GROUP BY ALL")
def combined_segments(spark, sf_dir):
    m = _modes(spark, sf_dir)
    return rounded(T.combined([(m, 0.7), (m.withColumn("cost", F.lit(1.0)), 0.3)], ["zone", "mode"], "cost"), 9)


@query("""WITH b AS (SELECT c_nationkey AS zone, floor(c_acctbal / 2500) * 2500 AS lo, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT zone, lo + 2500 * (i - 0.5::DOUBLE) / n AS x FROM b, range(1, 2000) r(i) WHERE i <= n)
    SELECT zone, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM s GROUP BY 1""")
def bracket_incomes(spark, sf_dir):
    lo = (F.floor(F.col("c_acctbal") / 2500) * 2500).cast("double").alias("lo")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone"), lo).agg(F.count(F.lit(1)).alias("n")).withColumn("hi", F.col("lo") + 2500)
    return rounded(T.bracket_incomes(counts, "zone", "lo", "hi", "n"))


@query(f"WITH {MODES} SELECT zone, round(max(cost), 6) AS largest FROM m GROUP BY 1")
def largest_cost(spark, sf_dir):
    return rounded(S.describe(_modes(spark, sf_dir), "cost", "zone").select("zone", F.col("most").alias("largest")))


WALK = TR.Walk(3, 3)
MOVES = ", ".join(f"({s}, {d}, {p!r})" for s, d, p in zip(*(x.tolist() for x in WALK.edges())))


@query(f"""WITH RECURSIVE n AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, (event_id * 37 % 1009) / 1009::DOUBLE * 3 AS y, (event_id * 53 % 1013) / 1013::DOUBLE * 3 AS x FROM events),
    e(src, dst, p) AS (SELECT a, b, c::DOUBLE FROM (VALUES {MOVES}) e(a, b, c)),
    v(key, t, s, logp, prev) AS (SELECT key, t, CAST(s AS INTEGER), ln(0.5::DOUBLE) - ln(72) - (pow(s // 48 - y, 2) + pow(s // 16 % 3 - x, 2)) / 0.5::DOUBLE, -1 FROM n, range({WALK.states}) r(s) WHERE t = 0
        UNION ALL SELECT v.key, n.t, e.dst, max(logp + p) - (pow(e.dst // 48 - n.y, 2) + pow(e.dst // 16 % 3 - n.x, 2)) / 0.5::DOUBLE, arg_max(e.src, logp + p) FROM v JOIN e ON e.src = v.s JOIN n ON n.key = v.key AND n.t = v.t + 1 GROUP BY v.key, n.t, e.dst, n.y, n.x),
    w(key, t, s) AS (SELECT key, max(t), arg_max(s, (t, logp)) FROM v GROUP BY key UNION ALL SELECT v.key, v.t - 1, v.prev FROM w JOIN v USING (key, t, s) WHERE v.t > 0),
    l AS (SELECT key, arg_max(logp, (t, logp)) AS logp FROM v GROUP BY key)
    SELECT event_id, CAST(s // 48 AS INTEGER) AS lati, CAST(s // 16 % 3 AS INTEGER) AS loni, round(l.logp, 6) AS logp FROM n JOIN w USING (key, t) JOIN l USING (key)""")
def likely_walks(spark, sf_dir):
    """The most likely way of each user through nine cells, from a place that each event gives with an error of half a cell."""
    k, order = F.col("event_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", (F.row_number().over(order) - 1).cast("long").alias("t"), (k * 37 % 1009 / 1009 * 3).alias("y"), (k * 53 % 1013 / 1013 * 3).alias("x"))
    placed = Scratch(spark, "walks").save(rows)
    found = TR.most_likely_walk(placed.withColumn("logp", TR.seen_near(F.col("y"), F.col("x"), WALK, 0.5)), WALK, 16)
    return rounded(placed.select("key", "t", "event_id").join(found, ["key", "t"]).select("event_id", "lati", "loni", "logp"))


def _grown_sql(steps: int, tries: int, seed: int) -> str:
    blocks = ["g0 AS (SELECT src, dst, w FROM edges WHERE FALSE)"]
    for k in range(steps):
        order = f"substr(md5(concat_ws(':', {seed}, {k}, src, dst)), 1, 12), src, dst"
        blocks += [
            f"o{k} AS MATERIALIZED (SELECT src, dst, w, row_number() OVER (ORDER BY {order}) - 1 AS try FROM edges WHERE (src = 0 OR src IN (SELECT dst FROM g{k})) AND (src, dst) NOT IN (SELECT (src, dst) FROM g{k}) QUALIFY try < {tries})",
            f"s{k} AS (SELECT try, 1000 * count(DISTINCT dst) - sum(w) AS score FROM (SELECT o.try, g.dst, g.w FROM g{k} g, o{k} o UNION ALL SELECT try, dst, w FROM o{k}) GROUP BY try)",
            f"g{k + 1} AS MATERIALIZED (SELECT * FROM g{k} UNION ALL SELECT src, dst, w FROM o{k} WHERE try = (SELECT try FROM s{k} ORDER BY score DESC, try LIMIT 1))",
        ]
    return ", ".join(blocks)


@query(f"WITH {EDGES}, {_grown_sql(8, 6, 9)} SELECT src, dst, w FROM g8")
def grown_network(spark, sf_dir):
    """Eight links from nation 0, each the best of six: new nations count much, links cost their weight."""
    score = lambda nets: nets.groupBy("try").agg((1000 * F.count_distinct("dst") - F.sum("w")).alias("score"))
    return N.grown(_edges(spark, sf_dir), 0, 8, 6, score, seed=9)
