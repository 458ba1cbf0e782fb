"""Queries of models, densities, signals, forests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import expression as E
from lithos.operators import density as D
from lithos.operators import fitting as A
from lithos.operators import forest as R
from lithos.operators import graph as N
from lithos.operators import inverse as I
from lithos.operators import tracking as K
from lithos.operators.grid import Grid
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.trees import _uniform, quote
from lithos.plans.views import rounded, table

TREE = ("add", ("div", "l_extendedprice", "l_quantity"), ("if", "l_discount", "l_tax", ("log", ("sub", "l_discount", "l_tax")), ("squash", ("mul", "l_tax", ("pow", "l_quantity", 2.2)))))


@query("""SELECT l_returnflag, round(sum(l_extendedprice / l_quantity + CASE WHEN l_discount >= l_tax THEN CASE WHEN l_discount - l_tax = 0 THEN 5e-324 ELSE ln(abs(l_discount - l_tax)) END
    ELSE atan(l_tax * pow(l_quantity, 2)) / (pi() / 2) END), 3) AS total FROM lineitem GROUP BY 1""")
def expr_tree_eval(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(E.column(TREE)).alias("total")), 3)


@query("""WITH m AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT dim, CAST(least(floor((x + 0.5) / 0.1::DOUBLE), 9) AS INTEGER) AS bin, count(*) AS cnt FROM m WHERE x BETWEEN -0.5 AND 0.5 GROUP BY ALL)
    SELECT CAST(d AS INTEGER) AS dim, CAST(b AS INTEGER) AS bin, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT dim AS d FROM m) t CROSS JOIN range(10) u(b) LEFT JOIN c ON c.dim = d AND c.bin = b""")
def density_marginal(spark, sf_dir):
    models = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("params"))
    dims = models.agg(F.max(F.size("params"))).first()[0] or 0
    return D.marginals(models, [(-0.5, 0.5)] * dims, 10).select("dim", "bin", "cnt")


@query()
def confidence_bounds(spark, sf_dir):
    models = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("params"))
    finite = F.filter("params", lambda x: F.abs(x) < float("inf"))
    dims, reach = models.agg(F.max(F.size("params")), F.max(F.array_max(F.transform(finite, F.abs)))).first()
    reach = max(0.5, reach or 0.0)  # no value lies outside
    hist = D.marginals(models, [(-reach, reach)] * (dims or 0), 20)
    return D.confidence(hist, 0.9).join(D.modes(hist), "dim").orderBy("dim")


@query("""WITH o AS (SELECT event_type AS rid, CAST(row_number() OVER (ORDER BY event_type) AS DOUBLE) AS k FROM events GROUP BY 1), ob AS (SELECT rid, -34.4::DOUBLE + k * 0.0625::DOUBLE AS lat, 150.1::DOUBLE + k * 0.125::DOUBLE AS lon FROM o),
    s AS (SELECT user_id AS sid, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS t, event_type AS rid, avg(-value / 4) AS dbm, count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT i AS lati, j AS loni, -34.5::DOUBLE + (i + 0.5) * (1.5::DOUBLE / 8) AS clat, 150.0::DOUBLE + (j + 0.5) * (1.7::DOUBLE / 8) AS clon FROM range(8) a(i), range(8) b(j)),
    m AS (SELECT rid, lati, loni, -30.0::DOUBLE - 20 * log10(greatest(2 * 6372795.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin((radians(clon) - radians(lon)) / 2), 2)))), 1)) AS ex FROM ob, c),
    j AS (SELECT sid, t, lati, loni, sum(n * (-0.5 * ((dbm - ex) / 6) * ((dbm - ex) / 6))) AS logp FROM s JOIN m USING (rid) GROUP BY ALL), x AS (SELECT *, max(logp) OVER (PARTITION BY sid, t) AS top FROM j)
    SELECT sid, t, CAST(lati AS INTEGER) AS lati, CAST(loni AS INTEGER) AS loni, round(exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY sid, t), 6) AS p FROM x""")
def signal_pmf(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    obs = events.select(F.col("user_id").alias("sid"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("t"), F.col("event_type").alias("rid"), (-F.col("value") / 4).alias("dbm"))
    types = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    observers = spark.createDataFrame([(x, -34.4 + k * 0.0625, 150.1 + k * 0.125, 0.0) for k, x in enumerate(types, 1)], "rid string, lat double, lon double, z double")
    return rounded(K.signal_grid(obs, observers, Grid(-34.5, 150.0, 1.5, 1.7, 8, 8)).select("sid", "t", "lati", "loni", "p"))


PMF = "pmf AS (SELECT s_nationkey AS sid, 0 AS t, CAST(s_suppkey % 40 AS INTEGER) AS lati, CAST((s_suppkey // 40) % 40 AS INTEGER) AS loni, count(*)::DOUBLE AS p FROM supplier GROUP BY ALL)"


def _pmf(spark, sf_dir):
    k = F.col("s_suppkey")
    place = (k % 40).cast("int").alias("lati"), (F.floor(k / 40) % 40).cast("int").alias("loni")
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sid"), F.lit(0).alias("t"), *place).agg(F.count(F.lit(1)).cast("double").alias("p"))


@query(f"""WITH {PMF}, d AS (SELECT i, j FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j <= 9),
    m AS (SELECT sid, t + 2 AS t, CAST(lati + i AS INTEGER) AS lati, CAST(loni + j AS INTEGER) AS loni, sum(p) AS p FROM pmf, d GROUP BY ALL) SELECT sid, t, lati, loni, round(p / sum(p) OVER (PARTITION BY sid, t), 9) AS p FROM m""")
def projected_pmf(spark, sf_dir):
    """Suppliers' places after two steps in open space: each cell's mass covers the disc around it evenly."""
    return rounded(K.projected(_pmf(spark, sf_dir), 2, 1.5).select("sid", "t", "lati", "loni", "p"), 9)


@query(f"""WITH RECURSIVE {V.REGIONS}, {PMF}, free AS (SELECT lati, loni FROM regions WHERE value % 5 <> 0), e AS (SELECT a.lati AS i, a.loni AS j, b.lati AS k, b.loni AS l FROM free a JOIN free b ON abs(a.lati - b.lati) + abs(a.loni - b.loni) = 1),
    walk(i, j, k, l, d) AS (SELECT lati, loni, lati, loni, 0 FROM free UNION ALL SELECT DISTINCT w.i, w.j, e.k, e.l, w.d + 1 FROM walk w JOIN e ON w.k = e.i AND w.l = e.j WHERE w.d < 6),
    near AS (SELECT i, j, k, l, s FROM (SELECT i, j, k, l, min(d) AS d FROM walk GROUP BY ALL), (SELECT unnest([2, 4, 6]) AS s) WHERE d <= s), w AS (SELECT i, j, k, l, 1 / count(*) OVER (PARTITION BY i, j, s) AS w FROM near),
    m AS (SELECT sid, t + 4 AS t, k AS lati, l AS loni, sum(p * w) AS p FROM pmf JOIN w ON lati = i AND loni = j GROUP BY ALL) SELECT sid, t, lati, loni, round(p / sum(p) OVER (PARTITION BY sid, t), 9) AS p FROM m""")
def projected_around(spark, sf_dir):
    """Suppliers' places after four seconds at three speeds, around the cells of every fifth nation."""
    free = V.regions(spark, sf_dir).where("value % 5 <> 0")
    edges = N.grid_graph(free, 40, F.lit(1.0))
    # a step costs one, so that six hops are all within the largest radius; cells without neighbours have themselves
    alone = free.select((F.col("lati").cast("long") * 40 + F.col("loni")).alias("origin"))
    paths = N.shortest_paths(edges, alone, 6)
    cell = lambda c, i, j: (F.floor(F.col(c) / 40).cast("int").alias(i), (F.col(c) % 40).cast("int").alias(j))
    reach = paths.select(*cell("origin", "lati", "loni"), *cell("node", "to_lati", "to_loni"), "dist")
    return rounded(K.projected_around(_pmf(spark, sf_dir), reach, 4, [0.5, 1.0, 1.5], 1.0).select("sid", "t", "lati", "loni", "p"), 9)


@query(f"""WITH {PMF}, r AS (SELECT *, -ln((CAST('0x' || substr(md5(concat_ws(':', 7, sid, t, draw, lati, loni)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) / p AS clock FROM pmf, range(1, 6) d(draw))
    SELECT sid, t, CAST(draw AS INTEGER) AS draw, arg_min(lati, (clock, lati, loni)) AS lati, arg_min(loni, (clock, lati, loni)) AS loni FROM r GROUP BY ALL""")
def sampled_cells(spark, sf_dir):
    return K.sampled_cells(_pmf(spark, sf_dir), 5, 7)


@query()
def random_forest(spark, sf_dir):
    """Mean squared error of a forest for part prices by size and key, against the mean's."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 100).cast("double").alias("tail"), "p_retailprice")
    model = R.train(parts, ["size", "tail"], "p_retailprice", 10, 6)
    out = R.predict(model, parts, ["size", "tail"])
    return out.agg(F.avg(F.pow(F.col("p_retailprice") - F.col("prediction"), F.lit(2.0))).alias("mse"), F.var_pop("p_retailprice").alias("variance"))


@query("""WITH s AS (SELECT DISTINCT p_size AS v FROM part), l AS (SELECT s.v, count(*) FILTER (p_size < s.v) AS n FROM s, part GROUP BY 1),
    e AS (SELECT s.v, (SELECT var_pop(p_retailprice) * count(*) FROM part WHERE p_size < s.v) + (SELECT var_pop(p_retailprice) * count(*) FROM part WHERE p_size >= s.v) AS e FROM s JOIN l USING (v) WHERE n > 0)
    SELECT v AS split, round(e, 2) AS error FROM e ORDER BY round(e, 2), v LIMIT 1""")
def best_split(spark, sf_dir):
    return rounded(R.best_splits(table(spark, sf_dir, "part"), "p_size", "p_retailprice"), 2)


@query("""WITH c AS (SELECT p_brand, p_size // 10 AS cls, count(*) AS n FROM part GROUP BY ALL), e AS (SELECT b.p_brand, k.cls, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_size // 10 AS cls FROM part) k LEFT JOIN c USING (p_brand, cls))
    SELECT p_brand, CAST(cls AS BIGINT) AS cls, round(greatest(n, 1) / sum(greatest(n, 1)) OVER (PARTITION BY p_brand), 9) AS p FROM e""")
def leaf_classes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_size") / 10).alias("cls"))
    return rounded(R.leaf_classes(parts, "p_brand", "cls", True), 9)


#: Customers' balances in thousands by the end of their key: the searches look for the line (intercept, slope) that fits best.
LINE = [(-10.0, 10.0), (-10.0, 10.0)]
SQL_LINE = "d AS (SELECT (c_custkey % 100) / 100::DOUBLE AS x, c_acctbal / 1000 AS y FROM customer)"


def _line(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(((F.col("c_custkey") % 100) / 100).alias("x"), (F.col("c_acctbal") / 1000).alias("y"))


def _squared(p):
    off = F.col("y") - p[0] - p[1] * F.col("x")
    return off * off


def _line_problem(spark, sf_dir) -> I.Problem:
    """The same misfit in closed form: one aggregate over the table, and any number of evaluations."""
    return I.Problem(tuple(LINE), A.line_error(A.line_statistics(_line(spark, sf_dir), F.col("x"), F.col("y"))))


def _drawn(seed: int, n: int) -> str:
    return f"(SELECT id, [-10.0::DOUBLE + {_uniform(seed, 'id', 0)} * 20.0::DOUBLE, -10.0::DOUBLE + {_uniform(seed, 'id', 1)} * 20.0::DOUBLE] AS p FROM range({n}) t(id))"


def _tried(models: str) -> str:
    return f"(SELECT id, p, avg((y - p[1] - p[2] * x) * (y - p[1] - p[2] * x)) AS e FROM {models}, d GROUP BY ALL)"


@query(f"WITH {SQL_LINE}, m AS {_tried(_drawn(1, 300))} SELECT id, round(p[1], 6) AS a, round(p[2], 6) AS b, round(e, 6) AS misfit FROM m ORDER BY e, id LIMIT 5")
def monte_carlo(spark, sf_dir):
    found = A.monte_carlo(spark, _line(spark, sf_dir), _squared, LINE, 300, 1)
    return rounded(I.best(found, 5).select("id", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "misfit"))


def _annealing_sql(chains: int, steps: int, hot: float, cold: float, seed: int) -> str:
    blocks = [f"s0 AS MATERIALIZED {_tried(_drawn(seed, chains))}"]
    for k in range(steps):
        heat = hot * (cold / hot) ** (k / max(1, steps - 1))
        axis, to, u = (_uniform(seed, f"'{x}'", k, "id") for x in ("axis", "to", "taken"))
        moved = f"(SELECT id, list_transform(p, lambda v, i: CASE WHEN i - 1 = floor({axis} * 2) THEN -10.0::DOUBLE + {to} * 20.0::DOUBLE ELSE v END) AS p FROM s{k})"
        blocks.append(f"t{k} AS MATERIALIZED {_tried(moved)}")
        blocks.append(f"s{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN ok THEN q ELSE p END AS p, CASE WHEN ok THEN f ELSE e END AS e FROM (SELECT s.id, s.p, s.e, t.p AS q, t.e AS f, t.e < s.e OR {_uniform(seed, quote('taken'), k, 's.id')} < exp(-(t.e - s.e) / {heat!r}::DOUBLE) AS ok FROM s{k} s JOIN t{k} t USING (id)))")
    return f"WITH {SQL_LINE}, {', '.join(blocks)} SELECT id, round(p[1], 6) AS a, round(p[2], 6) AS b, round(e, 6) AS misfit FROM s{steps}"


@query(_annealing_sql(8, 10, 20.0, 0.05, 3))
def annealing(spark, sf_dir):
    found = A.annealing(spark, _line(spark, sf_dir), _squared, LINE, 8, 10, 20.0, 0.05, 3)
    return rounded(found.select("id", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "misfit"))


def _genetic_sql(population: int, generations: int, mutation: float, seed: int) -> str:
    blocks = [f"s0 AS MATERIALIZED {_tried(_drawn(seed, population))}"]
    for g in range(generations):
        genes = ", ".join(f"least(greatest(CASE WHEN {_uniform(seed, quote('gene'), g, 'id', d)} < 0.5 THEN p[{d + 1}] ELSE o[{d + 1}] END + ({_uniform(seed, quote('noise'), g, 'id', d)} - 0.5::DOUBLE) * {2 * mutation * 20.0!r}::DOUBLE, -10), 10)" for d in range(2))
        pairs = f"(SELECT s.id, s.p, o.p AS o FROM (SELECT *, CAST(floor({_uniform(seed, quote('mate'), g, 'id')} * {population}) AS BIGINT) AS mate FROM s{g}) s JOIN s{g} o ON o.id = s.mate)"
        blocks.append(f"t{g} AS MATERIALIZED {_tried(f'(SELECT id, [{genes}] AS p FROM {pairs})')}")
        blocks.append(f"s{g + 1} AS MATERIALIZED (SELECT s.id, CASE WHEN t.e < s.e THEN t.p ELSE s.p END AS p, least(t.e, s.e) AS e FROM s{g} s JOIN t{g} t USING (id))")
    return f"WITH {SQL_LINE}, {', '.join(blocks)} SELECT id, round(p[1], 6) AS a, round(p[2], 6) AS b, round(e, 6) AS misfit FROM s{generations}"


@query(_genetic_sql(24, 5, 0.1, 4))
def genetic(spark, sf_dir):
    found = A.genetic(spark, _line(spark, sf_dir), _squared, LINE, 24, 5, 0.1, 4)
    return rounded(found.select("id", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "misfit"))


@query(f"WITH {SQL_LINE}, m AS {_drawn(5, 20)} SELECT id, round(-2 * avg(y - p[1] - p[2] * x), 6) AS da, round(-2 * avg((y - p[1] - p[2] * x) * x), 6) AS db FROM m, d GROUP BY id")
def gradient(spark, sf_dir):
    """Slopes of the misfit at drawn lines by finite differences, which for squares are the derivatives."""
    found = A.gradient(A.drawn_models(spark, LINE, 20, 5), _line(spark, sf_dir), _squared, 2)
    return rounded(found.select("id", F.get("gradient", F.lit(0)).alias("da"), F.get("gradient", F.lit(1)).alias("db")))


FITTED = f"WITH {SQL_LINE} SELECT CAST(chain AS INTEGER) AS chain, round(regr_intercept(y, x), 3) AS a, round(regr_slope(y, x), 3) AS b FROM d, range(4) c(chain) GROUP BY chain"


def _ends(found):
    return rounded(found.select("chain", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b")), 3)


@query(FITTED)
def powell(spark, sf_dir):
    """Where descents end: at the line of least squares."""
    return _ends(I.powell(spark, _line_problem(spark, sf_dir), 4))


@query(FITTED)
def hypercubes(spark, sf_dir):
    return _ends(I.hypercubes(spark, _line_problem(spark, sf_dir), 4, 50, 1e-4))


@query()
def mcmc(spark, sf_dir):
    samples = I.mcmc(spark, _line_problem(spark, sf_dir), 4, 500, sd=0.05, temperature=0.5, burn=100, seed=2)
    return samples.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.avg(F.get("params", F.lit(0))).alias("x"), F.avg(F.get("params", F.lit(1))).alias("y"))


@query()
def neighbourhood(spark, sf_dir):
    return I.best(I.neighbourhood(spark, _line_problem(spark, sf_dir), 50, 20, 4, 3))


@query()
def bounded_walks(spark, sf_dir):
    """How many of as many models as there are nations squared hold each value of each axis: four axes within the range of
    customers' balances, of which each is at most an eighth of the range off the one before."""
    low, high, n = table(spark, sf_dir, "customer").agg(F.min("c_acctbal"), F.max("c_acctbal"), F.count_distinct("c_nationkey")).first()
    four = I.Problem(((low, high),) * 4, lambda p: p[:, 0])
    drawn = I.bounded_walks(spark, four, [(high - low) / 8] * 3, 8 * n * n, 9, 4)
    return drawn.select(F.posexplode("params").alias("axis", "value")).groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, (min((l_extendedprice, l_orderkey, l_quantity::DOUBLE, l_discount)))[1] AS misfit, (min((l_extendedprice, l_orderkey, l_quantity::DOUBLE, l_discount)))[2] AS t, (min((l_extendedprice, l_orderkey, l_quantity::DOUBLE, l_discount)))[3] AS a, (min((l_extendedprice, l_orderkey, l_quantity::DOUBLE, l_discount)))[4] AS b FROM lineitem")
def stream_best_model(spark, sf_dir):
    """Best model of a log that is read as a stream of files."""
    import uuid

    from lithos.scratch import Scratch
    from lithos.sources.sinks import model_lines
    from lithos.streaming.models import running_best, tail

    lines = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount").alias("params"), F.col("l_orderkey").alias("t"), F.col("l_extendedprice").alias("misfit"))
    scratch = Scratch(spark, "stream")
    folder, name = f"{scratch.root}/log", f"best_{uuid.uuid4().hex}"
    model_lines(lines).write.text(folder)
    q = running_best(tail(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("n", "misfit", "t", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"))


@query("""SELECT user_id AS sid, count(*) AS packets, count(DISTINCT event_type) AS observers FROM events GROUP BY 1""")
def packets(spark, sf_dir):
    from lithos.operators.features import packets as of

    return of(table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("rid")))


@query("""WITH m AS (SELECT o_orderpriority AS r, o_orderstatus AS c, sum(CAST(o_totalprice * 100 AS BIGINT))::DOUBLE / 1e9 AS v FROM orders GROUP BY ALL)
    SELECT a.r, b.r AS c, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.c = b.c GROUP BY ALL""")
def matrix_product(spark, sf_dir):
    from lithos.operators.features import matrix_product as of

    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("r"), F.col("o_orderstatus").alias("c")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 1e9).alias("v"))
    return rounded(of(m, m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")))


@query("""WITH c AS (SELECT c_nationkey AS zone, CAST(floor((c_acctbal + 1000) / 2000) AS INTEGER) AS b, count(*) AS n FROM customer GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY zone ORDER BY b) AS upto, sum(n) OVER (PARTITION BY zone) AS t, row_number() OVER (PARTITION BY zone ORDER BY b) - 1 AS i FROM c),
    h AS (SELECT zone, min((i, n, upto, t)) AS h FROM r WHERE upto >= 0.5::DOUBLE * t GROUP BY 1), p AS (SELECT zone, h[1] + (0.5::DOUBLE * h[4] - (h[3] - h[2])) / h[2] AS p FROM h)
    SELECT zone, round(-1000 + floor(p) * 2000 + 2000 * (p - floor(p)), 4) AS median FROM p""")
def bracket_medians(spark, sf_dir):
    from lithos.operators.features import bracket_median

    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone"), F.floor((F.col("c_acctbal") + 1000) / 2000).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(bracket_median(counts, "zone", "b", "n", [-1000 + 2000 * i for i in range(8)]), 4)


DRAWS = 5


@query(f"""WITH RECURSIVE g AS (SELECT user_id AS sid, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS t, event_id % 12 AS y, (event_id // 12) % 12 AS x, value FROM events),
    pmf AS (SELECT sid, t, CAST(least(y + d, 11) AS INTEGER) AS lati, CAST(x AS INTEGER) AS loni, sum(value / (d + 1)) AS p FROM g, range(3) r(d) GROUP BY ALL),
    s AS (SELECT sid, t FROM (SELECT DISTINCT sid, t FROM pmf) QUALIFY count(*) OVER (PARTITION BY sid) > 1 AND max(t) OVER (PARTITION BY sid) - min(t) OVER (PARTITION BY sid) + 1 >= 40),
    a AS (SELECT s.sid, s.t, p.t AS p FROM s ASOF LEFT JOIN s p ON s.sid = p.sid AND s.t + 30 <= p.t),
    b AS (SELECT a.sid, a.t, CASE WHEN p < a.t + 120 THEN p END AS partner, coalesce(CASE WHEN p < a.t + 120 THEN p END, q.t) AS next FROM a ASOF LEFT JOIN s q ON a.sid = q.sid AND a.t + 120 <= q.t),
    w AS (SELECT sid, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT b.sid, b.next FROM w JOIN b USING (sid, t) WHERE b.next IS NOT NULL),
    pairs AS (SELECT sid, t AS t0, partner AS t1 FROM w JOIN b USING (sid, t) WHERE partner IS NOT NULL), needed AS (SELECT sid, t0 AS t FROM pairs UNION SELECT sid, t1 FROM pairs),
    r AS (SELECT sid, t, draw, lati, loni, -ln((CAST('0x' || substr(md5(concat_ws(':', 3, sid, t, draw, lati, loni)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) / p AS clock FROM pmf JOIN needed USING (sid, t), range(1, {4 * DRAWS + 1}) d(draw) WHERE p > 0),
    c AS MATERIALIZED (SELECT sid, t, draw, arg_min(lati, (clock, lati, loni)) AS i, arg_min(loni, (clock, lati, loni)) AS j FROM r GROUP BY ALL),
    m AS (SELECT pairs.sid, t1 - t0 AS dt, k > {DRAWS} AS back, c.i AS i0, c.j AS j0, e.i AS i1, e.j AS j1, CASE WHEN k > {DRAWS} THEN c.i - e.i ELSE e.i - c.i END AS di, e.j - c.j AS dj
        FROM pairs CROSS JOIN range(1, {2 * DRAWS + 1}) n(k) JOIN c ON c.sid = pairs.sid AND c.t = t0 AND c.draw = k JOIN c e ON e.sid = pairs.sid AND e.t = t1 AND e.draw = k + {2 * DRAWS}),
    v AS (SELECT *, sqrt((di * di + dj * dj)::DOUBLE) * 20.0::DOUBLE / dt AS speed, 1 / count(*) OVER (PARTITION BY sid) AS weight, CASE WHEN di * di < dj * dj THEN 'E' WHEN di >= 0 THEN 'N' ELSE 'S' END AS along FROM m),
    d AS (SELECT CASE WHEN speed < 0.5 THEN '-' WHEN back THEN translate(along, 'ENS', 'WSN') ELSE along END AS direction, weight, unnest([i0, i1]) AS i, unnest([j0, j1]) AS j FROM v WHERE speed <= 3)
    SELECT CAST(i // 6 * 2 + j // 6 AS INTEGER) AS sector, direction, round(sum(weight), 6) AS weight FROM d GROUP BY ALL""")
def direction_weights(spark, sf_dir):
    """Which way users go in the quarters of a grid of 12 x 12 cells; every event is a place and two north of it."""
    k = F.col("event_id")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    places = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.floor(seconds / 60).alias("t"), (k % 12).alias("y"), (F.floor(k / 12) % 12).cast("int").alias("loni"), "value").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(2))))
    pmf = places.groupBy("sid", "t", F.least(F.col("y") + F.col("d"), F.lit(11)).cast("int").alias("lati"), "loni").agg(F.sum(F.col("value") / (F.col("d") + 1)).alias("p"))
    half = [(0, -0.5, 5.5), (1, 5.5, 11.5)]
    boxes = spark.createDataFrame([(2 * a + b, s, n, w, e) for a, s, n in half for b, w, e in half], "sector int, s double, n double, w double, e double")
    return rounded(K.direction_weights(pmf, boxes, Grid(0.0, 0.0, 12.0, 12.0, 12, 12), 20.0, DRAWS, seed=3))
