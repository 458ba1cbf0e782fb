"""Queries of stateful streams: the tables come in two halves, and the stream is started again from its checkpoint between."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.plans.registry import query
from lithos.plans.views import table
from lithos.scratch import Scratch
from lithos.streaming import stateful as S


def _in_halves(spark, rows, transform):
    """Everything that a stream tells of `rows` (with t), which come in two halves by t; batch is the batch's number."""
    root = Scratch(spark, "streams").root
    middle = rows.agg(F.percentile_approx("t", 0.5)).first()[0]
    for half in (F.col("t") <= F.lit(middle), F.col("t") > F.lit(middle)):
        rows.where(half).write.mode("append").parquet(f"{root}/in")
        S.run_available(spark, f"{root}/in", rows.schema, transform, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


MODELS = "m AS (SELECT o_orderpriority AS source, o_orderkey AS t, [(o_custkey % 1000)::DOUBLE, o_totalprice::DOUBLE] AS params, abs(o_totalprice - 200000) / 100 AS misfit FROM orders)"
BOUNDS = [(0.0, 1000.0), (0.0, 300000.0)]


def _models(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    misfit = F.abs(F.col("o_totalprice") - 200000) / 100
    return o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("long").alias("t"), F.array((F.col("o_custkey") % 1000).cast("double"), F.col("o_totalprice").cast("double")).alias("params"), misfit.alias("misfit"))


@query(f"""WITH {MODELS}, b AS (SELECT *, min(misfit) OVER (PARTITION BY source ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m),
    r AS (SELECT *, max(CASE WHEN misfit < best - 5 THEN t END) OVER (PARTITION BY source) AS anew FROM b),
    x AS (SELECT source, d AS dim, (params[d + 1] - lo) / (hi - lo) AS x FROM r, (VALUES (0, 0::DOUBLE, 1000::DOUBLE), (1, 0::DOUBLE, 300000::DOUBLE)) v(d, lo, hi) WHERE anew IS NULL OR t >= anew),
    c AS (SELECT source, dim, least(floor(x * 20), 19) AS bin, count(*) AS cnt FROM x WHERE x BETWEEN 0 AND 1 GROUP BY ALL)
    SELECT source, CAST(dim AS INTEGER) AS dim, CAST(bin AS INTEGER) AS bin, cnt FROM c""")
def stream_density(spark, sf_dir):
    """Densities of models since the last one that was much better than all before."""
    told = _in_halves(spark, _models(spark, sf_dir), lambda df: S.running_density(df, BOUNDS, 20))
    return S.latest(told).where("cnt > 0")


@query(f"""WITH {MODELS}, r AS (SELECT source, misfit, t, row_number() OVER (PARTITION BY source ORDER BY misfit, t) AS rank FROM m)
    SELECT source, CAST(rank AS INTEGER) AS rank, misfit, t FROM r WHERE rank <= 25""")
def stream_top_models(spark, sf_dir):
    """Each source's 25 best models."""
    return S.latest(_in_halves(spark, _models(spark, sf_dir), lambda df: S.top_models(df, 25)))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT user_id AS source, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS t FROM events),
    a AS (SELECT s.source, s.t, p.t AS p FROM s ASOF LEFT JOIN s p ON s.source = p.source AND s.t + 30 <= p.t),
    b AS (SELECT a.source, a.t, CASE WHEN p < a.t + 120 THEN p END AS partner, coalesce(CASE WHEN p < a.t + 120 THEN p END, q.t) AS next FROM a ASOF LEFT JOIN s q ON a.source = q.source AND a.t + 120 <= q.t),
    w AS (SELECT source, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT b.source, b.next FROM w JOIN b USING (source, t) WHERE b.next IS NOT NULL)
    SELECT source, t AS t0, partner AS t1 FROM w JOIN b USING (source, t) WHERE partner IS NOT NULL""")
def stream_gap_pairs(spark, sf_dir):
    """Pairs of a user's events, in minutes for seconds: the first one 30 to 120 later is the partner and the next start."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.floor(seconds / 60).alias("t"))
    return _in_halves(spark, rows, S.gap_pairs).select("source", "t0", "t1")
