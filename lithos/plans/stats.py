"""Queries of descriptive statistics, shares, bins and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import bins as B
from lithos.operators import order as O
from lithos.operators import stats as S
from lithos.plans.registry import query
from lithos.plans.views import rounded, table


@query("""SELECT c_nationkey, count(c_acctbal) AS n, round(sum(c_acctbal), 6) AS total, round(sum(c_acctbal * c_acctbal), 4) AS sum_sq, round(avg(c_acctbal), 6) AS mean,
    round(median(c_acctbal), 6) AS median, min(c_acctbal) AS least, max(c_acctbal) AS most, round(stddev_pop(c_acctbal), 6) AS sd_pop, round(stddev_samp(c_acctbal), 6) AS sd_samp
    FROM customer GROUP BY c_nationkey""")
def describe_stats(spark, sf_dir):
    out = S.describe(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey")
    return rounded(out, skip=("sum_sq", "least", "most")).withColumn("sum_sq", F.round("sum_sq", 4))


@query("SELECT o_orderpriority, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def median_by_group(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median")))


@query("SELECT c_nationkey, list_sort(list(c_acctbal))[len(list(c_acctbal)) // 2 + 1] AS upper_median FROM customer GROUP BY 1")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(S.upper_median("c_acctbal").alias("upper_median"))


HIST = """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    c AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS cnt FROM orders, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 6) AS edge, coalesce(cnt, 0) AS cnt FROM range(10) t(i) LEFT JOIN c ON c.bin = t.i, b"""


@query(HIST)
def histogram_fixed(spark, sf_dir):
    return rounded(S.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10))


@query("""WITH c AS (SELECT o_orderstatus, CAST(least(floor((o_totalprice - 0.0) / 50000.0::DOUBLE), 9) AS INTEGER) AS bin, count(*) AS cnt FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY ALL)
    SELECT s.o_orderstatus, CAST(i AS INTEGER) AS bin, i * 50000.0::DOUBLE AS edge, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN range(10) t(i)
    LEFT JOIN c ON c.bin = t.i AND c.o_orderstatus = s.o_orderstatus""")
def histogram_by_group(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10, 0, 500000, "o_orderstatus")


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), t AS (SELECT CAST(i AS INTEGER) AS n, lo, hi FROM range(1, 41) r(i), b),
    c AS (SELECT n, CAST(least(floor((c_acctbal - lo) / ((hi - lo) / n)), n - 1) AS INTEGER) AS bin, count(*) AS cnt, any_value(lo) AS lo, any_value(hi) AS hi FROM customer, t GROUP BY 1, 2),
    f AS (SELECT n, min(cnt) AS least, count(*) AS filled FROM c GROUP BY n), bad AS (SELECT coalesce(min(n), 41) AS bad FROM f WHERE least < 60 OR filled < n)
    SELECT n, bin, round(lo + bin * (hi - lo) / n, 6) AS edge, cnt FROM c, bad WHERE n = greatest(bad - 1, 1)""")
def histogram_adaptive(spark, sf_dir):
    return rounded(S.adaptive_histogram(table(spark, sf_dir, "customer"), "c_acctbal", 60, 40))


@query(f"WITH h AS ({HIST}), w AS (SELECT (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders) SELECT round(edge + w / 2, 4) AS mode, cnt FROM h, w ORDER BY cnt DESC, bin LIMIT 1")
def mode_from_hist(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return rounded(S.histogram_mode(S.histogram(orders, "o_totalprice", 10), width=(hi - lo) / 10), 4)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    m AS (SELECT *, floor(n * 0.1::DOUBLE + 1e-9) AS m FROM r)
    SELECT event_type, min(value) AS lo, max(value) AS hi FROM m WHERE r > ceil(m / 2) AND r <= n - floor(m / 2) GROUP BY 1""")
def two_tailed_bounds(spark, sf_dir):
    return S.tail_bounds(table(spark, sf_dir, "events"), "value", 0.9, "event_type")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
    SELECT source, round(-sum(p * log2(p)) + 0.0, 6) + 0.0::DOUBLE AS entropy FROM p GROUP BY 1""")
def entropy_by_group(spark, sf_dir):
    return rounded(S.entropy(table(spark, sf_dir, "documents"), "lang", "source"))


@query("SELECT s_suppkey, round(abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 9) AS share FROM supplier")
def normalise_share(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("v", F.abs("s_acctbal"))
    return rounded(S.shares(df, "v", "s_nationkey").select("s_suppkey", "share"), 9)


@query("""WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM s),
    k AS (SELECT *, max(share) OVER (PARTITION BY p_brand) AS top FROM p), f AS (SELECT * FROM k WHERE CASE WHEN top >= 0.95 THEN share = top ELSE share >= 0.01 END)
    SELECT p_brand, p_type, round(share / sum(share) OVER (PARTITION BY p_brand), 9) AS new_share FROM f""")
def share_threshold(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(S.dominant_shares(S.shares(counts, "n", "p_brand"), "p_brand", "share", drop=0.01).select("p_brand", "p_type", "new_share"), 9)


@query("""WITH RECURSIVE it(k, lo, hi, m, s, n) AS (SELECT 0, min(l_extendedprice), max(l_extendedprice), avg(l_extendedprice), stddev_pop(l_extendedprice), count(l_extendedprice) FROM lineitem UNION ALL
    SELECT it.k + 1, min(l_extendedprice), max(l_extendedprice), avg(l_extendedprice), stddev_pop(l_extendedprice), count(*) FROM it JOIN lineitem ON l_extendedprice BETWEEN it.lo AND it.hi AND abs(l_extendedprice - it.m) < 2 * it.s
    GROUP BY it.k, it.n HAVING count(*) < it.n), last AS (SELECT arg_max(lo, k) AS lo, arg_max(hi, k) AS hi FROM it)
    SELECT NOT l_extendedprice BETWEEN lo AND hi AS clipped, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem, last GROUP BY 1""")
def sigma_clip_3(spark, sf_dir):
    flags = S.sigma_flags(table(spark, sf_dir, "lineitem"), "l_extendedprice", 2.0)
    return flags.groupBy("clipped").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem), b AS (
    SELECT list_sort(list(l_quantity))[CAST(floor(0.05 * any_value(n) + 0.5) + 1 AS BIGINT)] AS q0, list_sort(list(l_quantity))[CAST(floor(0.95 * any_value(n) + 0.5) AS BIGINT)] AS q1,
    list_sort(list(l_extendedprice))[CAST(floor(0.05 * any_value(n) + 0.5) + 1 AS BIGINT)] AS e0, list_sort(list(l_extendedprice))[CAST(floor(0.95 * any_value(n) + 0.5) AS BIGINT)] AS e1 FROM lineitem, n)
    SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 3) AS total FROM lineitem, b WHERE l_quantity BETWEEN q0 AND q1 AND l_extendedprice BETWEEN e0 AND e1 GROUP BY 1""")
def percentile_band(spark, sf_dir):
    kept = S.percentile_band(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 0.05)
    return rounded(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 3)


@query("SELECT d.lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def complete_case(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return S.complete_cases(joined, ["quality", "toxic"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier)
    SELECT s_suppkey, CAST(least(floor(r / greatest(floor(n / 7), 1)), 6) AS INTEGER) AS bin FROM r""")
def equal_number_bins(spark, sf_dir):
    return B.equal_count_bins(table(spark, sf_dir, "supplier"), "s_acctbal", 7, ["s_suppkey"]).select("s_suppkey", "bin")


@query("""WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
    SELECT CAST(least(floor((s_acctbal - lo) / ((hi - lo) / 5)), 4) AS INTEGER) AS bin, count(*) AS n FROM supplier, b GROUP BY 1""")
def equal_range_bins(spark, sf_dir):
    return B.equal_range_bins(table(spark, sf_dir, "supplier"), "s_acctbal", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST((c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 5000)::INT + (c_acctbal >= 7500)::INT AS INTEGER) AS class, count(*) AS n FROM customer GROUP BY 1""")
def custom_breaks(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(B.break_class(F.col("c_acctbal"), [0, 2500, 5000, 7500]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, (floor(l_quantity / 5) + 0.5) * 5.0::DOUBLE AS centre, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS median,
    count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2""")
def binned_upper_median(spark, sf_dir):
    return B.binned_upper_median(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 5)


@query("""WITH c AS (SELECT c_nationkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, count(*) AS c FROM customer GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w - 1 AS i, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY c_nationkey) AS n FROM c WINDOW w AS (PARTITION BY c_nationkey ORDER BY band)),
    h AS (SELECT c_nationkey, min((i, c, upto, n)) AS h FROM r WHERE upto >= 0.5::DOUBLE * n GROUP BY 1)
    SELECT c_nationkey, round(h[1] + (0.5::DOUBLE * h[4] - (h[3] - h[2])) / h[2], 6) AS position FROM h""")
def grouped_quantile(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("band")).agg(F.count(F.lit(1)).alias("c"))
    return rounded(S.grouped_quantile(counts, "c_nationkey", "band", "c", 0.5))


@query("""WITH n AS (SELECT n_nationkey, n_regionkey, CASE WHEN count(s_suppkey) > 2 THEN sum(s_acctbal) END AS v FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL)
    SELECT n_regionkey, CASE WHEN count(*) = count(v) THEN round(sum(v), 6) END AS total, count(*) AS members FROM n GROUP BY 1""")
def additive_rollup_null(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    nations = joined.groupBy("n_nationkey", "n_regionkey").agg(F.when(F.count("s_suppkey") > 2, F.sum("s_acctbal")).alias("v"))
    return rounded(S.rollup_or_null(nations, "n_regionkey", "v"))


@query("""SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS level, sum(l_quantity) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def weighted_crosstab(spark, sf_dir):
    return rounded(S.weighted_crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_discount", "l_quantity"), 9)


@query("""SELECT l_returnflag, round(1 - sum((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""")
def r_squared(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return rounded(S.r_squared(df, "l_extendedprice", "p", "l_returnflag"))


def _fit_oracle(x: str, y: str, back: bool = False) -> str:
    b = f"regr_intercept({y}, {x})"
    return f"SELECT l_returnflag, round(regr_slope({y}, {x}), 6) + 0.0 AS a, round({'exp(' + b + ')' if back else b}, 5) AS b, round(regr_r2({y}, {x}), 6) AS r2 FROM lineitem GROUP BY 1"


def _fit(spark, sf_dir, shape, x="l_quantity", y="l_extendedprice"):
    out = S.fit(table(spark, sf_dir, "lineitem"), x, y, shape, "l_returnflag")
    return out.select("l_returnflag", (F.round("a", 6) + F.lit(0.0)).alias("a"), F.round("b", 5).alias("b"), F.round("r2", 6).alias("r2"))


@query(_fit_oracle("l_quantity", "l_extendedprice"))
def linear_fit(spark, sf_dir):
    return _fit(spark, sf_dir, "linear")


@query(_fit_oracle("ln(1 + l_quantity)", "l_extendedprice"))
def log_fit(spark, sf_dir):
    return _fit(spark, sf_dir, "log")


@query(_fit_oracle("l_quantity", "ln(1 + l_extendedprice)"))
def exp_fit(spark, sf_dir):
    return _fit(spark, sf_dir, "exp")


@query(_fit_oracle("ln(l_quantity)", "ln(l_extendedprice)", True))
def pow_fit(spark, sf_dir):
    return _fit(spark, sf_dir, "pow")


@query("""WITH t AS (SELECT l_quantity::DOUBLE AS x, l_quantity::DOUBLE * l_quantity AS x2, l_extendedprice AS y FROM lineitem),
    m AS (SELECT var_pop(x) AS uu, var_pop(x2) AS vv, covar_pop(x, x2) AS uv, covar_pop(x, y) AS uy, covar_pop(x2, y) AS vy, avg(x) AS mx, avg(x2) AS mx2, avg(y) AS my FROM t),
    s AS (SELECT *, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS a, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b FROM m)
    SELECT round(a, 4) AS a, round(b, 4) AS b, round(my - b * mx - a * mx2, 4) AS c FROM s""")
def poly2_fit(spark, sf_dir):
    c = S.fit_polynomial(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 2)
    return rounded(spark.createDataFrame([tuple(c)], "a double, b double, c double"), 4)


@query("""WITH t AS (SELECT sum(l_quantity) AS w FROM lineitem), v AS (SELECT l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
    r AS (SELECT v.*, sum(v.w) OVER (ORDER BY v) AS upto, t.w AS tw FROM v, t)
    SELECT CAST(least(floor((upto - w / 2) / tw * 5), 4) AS INTEGER) AS bucket, round(sum(w), 3) AS weight, round(sum(v * w) / sum(w), 3) AS mean FROM r GROUP BY 1""")
def weighted_quintiles(spark, sf_dir):
    return rounded(S.weighted_quintiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), 3)


@query("SELECT round(count(*) / sum(1 / (1 + l_tax)), 9) AS evidence, l_returnflag FROM lineitem GROUP BY l_returnflag")
def harmonic_evidence(spark, sf_dir):
    return rounded(S.harmonic_evidence(table(spark, sf_dir, "lineitem").withColumn("p", 1 + F.col("l_tax")), "p", "l_returnflag"), 9)


@query("""SELECT o_orderkey, o_totalprice, CAST(25 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 25""")
def kth_best(spark, sf_dir):
    return O.kth_best(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 25).select("o_orderkey", "o_totalprice", "rank")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT i AS part, n // 5 + (i < n % 5)::INT AS size, n FROM range(5) r(i), n)
    SELECT CAST(part AS INTEGER) AS fold, test, CASE WHEN test THEN size ELSE n - size END AS n FROM p CROSS JOIN (VALUES (true), (false)) t(test)""")
def kfold_counts(spark, sf_dir):
    dealt = O.folds(table(spark, sf_dir, "customer").select("c_custkey"), 5, 7, "c_custkey")
    return dealt.groupBy("fold", "test").agg(F.count(F.lit(1)).alias("n"))


@query()
def bootstrap(spark, sf_dir):
    drawn = O.bootstrap(table(spark, sf_dir, "customer").select("c_custkey"), 3, "c_custkey")
    return drawn.groupBy("times").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_id, sum(value) OVER (ORDER BY ts, event_id) AS upto FROM events)
    SELECT event_id, round(upto, 4) AS upto FROM r WHERE upto >= 10000 ORDER BY upto, event_id LIMIT 1""")
def cum_threshold(spark, sf_dir):
    hit = O.cumulative_threshold(table(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", 10000)
    return rounded(hit.select("event_id", "upto"), 4)


@query("SELECT (SELECT count(*) FROM (SELECT value, lag(value) OVER (ORDER BY ts, event_id) AS b FROM events) WHERE value < b) = 0 AS sorted")
def sorted_check(spark, sf_dir):
    return O.is_sorted(table(spark, sf_dir, "events"), ["ts", "event_id"], "value")


def _classes_sql(k: int, rounds: int) -> str:
    blocks = [f"c0 AS (SELECT quantile_cont(v, [{', '.join(str((i + 0.5) / k) for i in range(k))}]) AS c FROM v)"]
    near = f"len(list_filter(list_transform(range(1, {k}), lambda i: (c[i] + c[i + 1]) / 2), lambda m: m < v))"
    for r in range(rounds):
        blocks.append(f"c{r + 1} AS MATERIALIZED (SELECT list_sort(list(coalesce(m, old))) AS c FROM (SELECT i, c[i + 1] AS old FROM c{r}, range({k}) t(i)) LEFT JOIN (SELECT {near} AS a, avg(v) AS m FROM v, c{r} GROUP BY 1) ON a = i)")
    return f"""WITH v AS (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1), {", ".join(blocks)}
        SELECT CAST({near} AS INTEGER) AS class, count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean FROM v, c{rounds} GROUP BY 1"""


@query(_classes_sql(4, 20))
def classify_regions(spark, sf_dir):
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return rounded(B.class_statistics(B.classify(nations, "v", 4, "kmeans"), "v"))


def _kmeans_sql(k: int, rounds: int) -> str:
    blocks = [f"a0 AS (SELECT id, CAST(id % {k} AS INTEGER) AS c FROM v)"]
    far = "sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i]))))"
    mean = "SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, avg(x) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM v JOIN a{r} USING (id)) GROUP BY c, i) GROUP BY c"
    for r in range(rounds + 1):
        old = f"UNION ALL SELECT c, m FROM m{r - 1} WHERE c NOT IN (SELECT c FROM a{r})" if r else ""
        blocks.append(f"m{r} AS MATERIALIZED ({mean.format(r=r)} {old})")
        blocks.append(f"a{r + 1} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, c, {far} AS d FROM v, m{r}) GROUP BY id)")
    return f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), {", ".join(blocks)}
        SELECT c AS cluster, count(*) AS n, round(avg(d), 6) AS mean FROM a{rounds + 1} GROUP BY c"""


@query(_kmeans_sql(10, 8))
def kmeans(spark, sf_dir):
    found = B.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, 8)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean"))


@query("""SELECT c_mktsegment AS segment, c_nationkey AS nation, GROUPING(c_mktsegment, c_nationkey) AS level, round(sum(c_acctbal * (1 + c_custkey % 5)) / sum(1 + c_custkey % 5), 6) AS mean, CAST(sum(1 + c_custkey % 5) AS BIGINT) AS weight
    FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def crosstab_cube(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal", (1 + F.col("c_custkey") % 5).alias("w"))
    return rounded(S.weighted_crosstab(people, "segment", "nation", "c_acctbal", "w"))


@query("""WITH m AS (SELECT c_nationkey AS region, c_custkey % 3 AS category, c_acctbal AS value FROM customer UNION ALL SELECT s_nationkey, s_suppkey % 4, s_acctbal FROM supplier)
    SELECT region, category, round(sum(value), 2) AS total FROM m WHERE region IN (SELECT n_nationkey FROM nation) GROUP BY ALL""")
def merged_totals(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), (F.col("c_custkey") % 3).alias("category"), F.col("c_acctbal").alias("value"))
    other = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), (F.col("s_suppkey") % 4).alias("category"), F.col("s_acctbal").alias("value"))
    return rounded(S.merged_totals([one, other], table(spark, sf_dir, "nation").select("n_nationkey")), 2)
