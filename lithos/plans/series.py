"""Queries of time series, bars and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import timeseries as T
from lithos.operators.scan import smoothed_series
from lithos.plans import views as V
from lithos.plans.registry import query
from lithos.plans.views import BARS, rounded, table

EVENTS = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, lead(event_id) OVER w IS NULL AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, sf_dir):
    w = T.chain("user_id", ["ts", "event_id"])
    after = F.lead("event_id").over(w)
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), after.alias("after"), after.isNull().alias("last"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x), 6) AS ema FROM events GROUP BY 1")
def ema(spark, sf_dir):
    return rounded(T.smoothed_last(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.3))


@query(f"WITH {BARS} SELECT d, round(list_reduce(list(close) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), lambda a, x: 0.75::DOUBLE * a + 0.25::DOUBLE * x), 6) AS smooth FROM bars")
def ema_by_bar(spark, sf_dir):
    return rounded(smoothed_series(V.bars(spark, sf_dir).select("d", "close"), None, ["d"], "close", 0.25).select("d", "smooth"))


@query("""WITH RECURSIVE n AS (SELECT event_type AS k, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT k, event_id, i, value AS s FROM n WHERE i = 1 UNION ALL SELECT n.k, n.event_id, n.i, 0.1::DOUBLE * n.value + 0.9::DOUBLE * s.s FROM s JOIN n ON n.k = s.k AND n.i = s.i + 1)
    SELECT event_id, round(s, 6) AS smooth FROM s""")
def ema_by_event(spark, sf_dir):
    """Every event's value smoothed along its type: few keys, each a long series."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return rounded(smoothed_series(events, "event_type", ["ts", "event_id"], "value", 0.1).select("event_id", "smooth"))


@query(f"WITH {BARS} SELECT d, open, high, low, close, volume FROM bars")
def ohlc_bars(spark, sf_dir):
    return V.bars(spark, sf_dir).select("d", "open", "high", "low", "close", "volume")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS average FROM events")
def moving_average(spark, sf_dir):
    w = T.chain("user_id", ["ts", "event_id"])
    return rounded(table(spark, sf_dir, "events").select("event_id", T.moving_average(F.col("value"), w, 5).alias("average")))


@query("""WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER w AS diff, (value - lag(value) OVER w) / lag(value) OVER w AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(stddev_samp(diff) OVER v, 6) AS vol, round(avg(pct) OVER v, 6) AS mean_pct, round(stddev_samp(pct) OVER v, 6) AS pct_vol FROM d
    WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def volatility(spark, sf_dir):
    out = T.with_volatility(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 10)
    return rounded(out.select("event_id", "vol", "mean_pct", "pct_vol"))


@query("SELECT event_id, round((value - lag(value, 3) OVER w) / 3, 6) AS change, round(lag(value, 2) OVER w / value, 6) AS earlier FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def mean_change(spark, sf_dir):
    w = T.chain("user_id", ["ts", "event_id"])
    return rounded(table(spark, sf_dir, "events").select("event_id", T.change(F.col("value"), w, 3).alias("change"), T.earlier_close(F.col("value"), w, 2).alias("earlier")))


@query(f"WITH {BARS} SELECT d, round((high - low) / open, 6) AS day_range, coalesce((d - lag(d) OVER (ORDER BY d) = 1) OR (d - lag(d) OVER (ORDER BY d) = 3 AND dayofweek(d) = 1), NULL) AS follows FROM bars")
def day_ranges(spark, sf_dir):
    w = T.Window.partitionBy(F.lit(0)).orderBy("d")
    return rounded(V.bars(spark, sf_dir).select("d", T.day_range(F.col("high"), F.col("low"), F.col("open")).alias("day_range"), T.consecutive_trading_day(F.col("d"), w).alias("follows")))


@query("SELECT dayofweek(ts) = 5 AS friday, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def weekday_split(spark, sf_dir):
    from lithos.functions.text import is_friday

    return rounded(table(spark, sf_dir, "events").groupBy(is_friday(F.col("ts")).alias("friday")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(f"WITH {EVENTS}, f AS (SELECT user_id, min(s) AS s0 FROM e GROUP BY 1) SELECT event_id, s - s0 AS second FROM e JOIN f USING (user_id)")
def since_first(spark, sf_dir):
    return T.since_first(table(spark, sf_dir, "events"), "ts", "user_id").select("event_id", "second")


@query("""WITH s AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS t FROM events), x AS (SELECT DISTINCT user_id, event_type, t + d AS t FROM s, range(-1, 2) r(d))
    SELECT CAST(user_id AS VARCHAR) AS sid, t, string_agg(event_type, ',' ORDER BY event_type) AS seen FROM x GROUP BY ALL""")
def seen_by(spark, sf_dir):
    from lithos.operators.tracking import seen_by as of

    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sid"), F.col("event_type").alias("rid"), F.floor(T.second_of(F.col("ts")) / 60).alias("t"))
    return of(events).select("sid", "t", F.array_join("seen", ",").alias("seen"))


@query("""WITH d AS (SELECT user_id, (value - lag(value) OVER w) / lag(value) OVER w AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(stddev_samp(pct), 6) AS pct_vol FROM d GROUP BY 1""")
def pct_volatility(spark, sf_dir):
    return rounded(T.pct_volatility(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value"))


@query("""WITH RECURSIVE n AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS x, value AS y, row_number() OVER w - 1 AS i, lead(floor(epoch(ts))::DOUBLE) OVER w AS nx, lead(value) OVER w AS ny FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    m AS (SELECT user_id, i, x AS lx, y AS ly, TRUE AS kept FROM n WHERE i = 0
        UNION ALL SELECT user_id, i, CASE WHEN kept THEN x ELSE lx END, CASE WHEN kept THEN y ELSE ly END, kept FROM (
            SELECT n.user_id, n.i, x, y, lx, ly, nx IS NULL OR coalesce(abs((nx - lx) * (y - ly) - (ny - ly) * (x - lx)) / nullif(sqrt((nx - lx) * (nx - lx) + (ny - ly) * (ny - ly)), 0),
                sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly))) > 25 AS kept FROM m JOIN n ON n.user_id = m.user_id AND n.i = m.i + 1))
    SELECT user_id, count(*) AS kept FROM m WHERE kept GROUP BY 1""")
def thinned_tracks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", T.second_of(F.col("ts")).cast("double").alias("x"), "value")
    return T.thinned(events, "user_id", "ts", "x", "value", 25.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM events),
    v AS (SELECT event_id, [stddev_samp(diff) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING), stddev_samp(diff) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING),
        stddev_samp(diff) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING)] AS vols FROM d), f AS (SELECT event_id, list_filter(vols, lambda x: x IS NOT NULL) AS vols FROM v)
    SELECT event_id, round(CASE WHEN len(vols) > 0 THEN list_reduce(vols, lambda a, x: 0.5::DOUBLE * a + 0.5::DOUBLE * x) END, 6) AS vol_smooth FROM f""")
def smooth_volatility(spark, sf_dir):
    out = T.smooth_volatility(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", [2, 4, 8], 0.5)
    return rounded(out.select("event_id", "vol_smooth"))
