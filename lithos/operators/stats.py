"""Descriptive statistics, histograms, shares, fits. Nulls never count; give NaN as null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys_of(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def describe(df: DataFrame, value: str, by=None) -> DataFrame:
    """n, sum, sum of squares, mean, median, least, most and both standard deviations of a column, a group each.
    sd_pop divides by n and sd_samp by n - 1."""
    v = F.col(value)
    return df.groupBy(*keys_of(by)).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("sum_sq"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"),
    )


def upper_median(v) -> Column:
    """Aggregate: the element at n / 2 (from 0) of the sorted values."""
    ordered = F.sort_array(F.collect_list(v))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def bin_of(v: Column, lo, hi, n: int) -> Column:
    """Number of the equal-width bin from 0; the upper edge belongs to the last; null outside."""
    width = (hi - lo) / n
    at = F.when(F.lit(width) > 0, F.floor((v - lo) / F.nullif(F.lit(width), F.lit(0.0)))).otherwise(F.lit(0))
    return F.when((v >= lo) & (v <= hi), F.least(at, F.lit(n - 1)).cast("int"))


def histogram(df: DataFrame, value: str, n: int, lo=None, hi=None, by=None) -> DataFrame:
    """bin, edge (its lower one) and cnt of n equal-width bins, empty ones too, over [lo, hi] or the column's range; values
    outside are left out."""
    keys = keys_of(by)
    ends = df.groupBy(*keys).agg((F.min(value) if lo is None else F.lit(float(lo))).alias("__lo"), (F.max(value) if hi is None else F.lit(float(hi))).alias("__hi"))
    bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = df.join(F.broadcast(ends), keys) if keys else df.crossJoin(F.broadcast(ends))
    width = (F.col("__hi") - F.col("__lo")) / n
    at = F.least(F.floor((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0))), F.lit(n - 1)).cast("int")
    inside = placed.where(F.col(value).between(F.col("__lo"), F.col("__hi"))).withColumn("bin", F.coalesce(at, F.lit(0)))
    counts = inside.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    edge = F.col("__lo") + F.col("bin") * width
    return bins.join(counts, [*keys, "bin"], "left").select(*keys, "bin", edge.alias("edge"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def adaptive_histogram(df: DataFrame, value: str, least: int, most_bins: int) -> DataFrame:
    """The histogram over the column's range with the most bins so that every bin still holds `least` values; the search
    goes up from one bin and ends at the first failure. One pass counts all numbers of bins."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    tries = ends.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most_bins))))
    width = (F.col("hi") - F.col("lo")) / F.col("n")
    at = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.col("n") - 1), F.lit(0)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(tries)).groupBy("n", at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    fits = counts.groupBy("n").agg((F.min("cnt") >= least).alias("enough"), F.count(F.lit(1)).alias("filled"))
    bad = fits.where(~F.col("enough") | (F.col("filled") < F.col("n"))).agg(F.coalesce(F.min("n"), F.lit(most_bins + 1)).alias("bad"))
    best = counts.crossJoin(F.broadcast(bad)).where(F.col("n") == F.greatest(F.col("bad") - 1, F.lit(1)))
    return best.select("n", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.col("n")).alias("edge"), "cnt")


def histogram_mode(bins: DataFrame, by=None, width: Column | float = 0.0) -> DataFrame:
    """Centre of the fullest bin (the first of several) of a histogram's rows."""
    top = bins.groupBy(*keys_of(by)).agg(F.max(F.struct("cnt", -F.col("bin"), "edge")).alias("top"))
    return top.select(*keys_of(by), (F.col("top.edge") + width / 2).alias("mode"), F.col("top.cnt").alias("cnt"))


def tail_bounds(df: DataFrame, value: str, p: float, by=None) -> DataFrame:
    """lo and hi that stay when the share 1 - p of the sorted values is dropped from both ends in turn, the lowest first."""
    from lithos.operators.order import prefix

    keys = keys_of(by)
    ranked = prefix(df.where(F.col(value).isNotNull()).select(*keys, value), [value], by=keys, out="r")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    m = F.floor(F.col("n") * F.lit(1 - p) + 1e-9)
    low, high = F.ceil(m / 2), F.floor(m / 2)
    return placed.where((F.col("r") > low) & (F.col("r") <= F.col("n") - high)).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def entropy(df: DataFrame, category: str, by=None, pseudo: float = 0.0) -> DataFrame:
    """Entropy in bits of a category's distribution, a group each; `pseudo` is added to each count that occurs."""
    keys = keys_of(by)
    counts = df.groupBy(*keys, category).agg((F.count(F.lit(1)) + pseudo).alias("n"))
    p = shares(counts, "n", keys, "p")
    return p.groupBy(*keys).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy"))


def shares(df: DataFrame, value: str, by=None, out: str = "share") -> DataFrame:
    """Each value's share of its group's sum; equal shares where that is 0. A join with the sums, so that a hot group
    splits."""
    keys = keys_of(by)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    joined = df.join(sums, keys) if keys else df.crossJoin(F.broadcast(sums))
    return joined.withColumn(out, F.when(F.col("__sum") == 0, 1 / F.col("__n")).otherwise(F.col(value) / F.nullif("__sum", F.lit(0.0)))).drop("__sum", "__n")


def mean_one(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """Values over their mean."""
    mean = df.agg(F.avg(value).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, F.try_divide(F.col(value), F.col("__mean"))).drop("__mean")


def dominant_shares(df: DataFrame, by, share: str, whole: float = 0.95, drop: float = 0.05) -> DataFrame:
    """Where a group's largest share is `whole` or more it takes all; else shares below `drop` go and the rest is scaled to 1."""
    keys = keys_of(by)
    top = df.groupBy(*keys).agg(F.max(share).alias("__top"))
    kept = df.join(top, keys).where(F.when(F.col("__top") >= whole, F.col(share) == F.col("__top")).otherwise(F.col(share) >= drop))
    return shares(kept.drop("__top"), share, keys, "new_share")


def sigma_clip(df: DataFrame, value: str, k: float = 3.0, rounds: int = 50) -> tuple[float, float, float, float]:
    """Mean, standard deviation (of the population) and bounds of the values left when those k deviations or more from
    the mean are dropped until none is. Only four numbers a round come to the driver; the data are filtered by bounds."""
    inside, before = F.col(value).isNotNull(), -1
    mean = sd = lo = hi = None
    for _ in range(rounds):
        row = df.where(inside).agg(F.avg(value), F.stddev_pop(value), F.min(value), F.max(value), F.count(value)).first()
        mean, sd, lo, hi, n = row
        if n == before or not n or not sd:
            break
        before = n
        inside = F.col(value).between(lo, hi) & (F.abs(F.col(value) - mean) < k * sd)
    return mean, sd, lo, hi


def sigma_flags(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """`df` with `clipped`: whether the value lies outside the bounds of sigma_clip()."""
    _, _, lo, hi = sigma_clip(df, value, k)
    return df.withColumn("clipped", F.lit(False) if lo is None else ~F.coalesce(F.col(value).between(lo, hi), F.lit(False)))


def residual_outliers(df: DataFrame, actual: str, predicted: str, k: float = 3.0) -> DataFrame:
    """`df` with `outlier`: residuals more than k deviations (n - 1) from their mean."""
    r = F.col(actual) - F.col(predicted)
    facts = df.agg(F.avg(r).alias("__m"), F.stddev_samp(r).alias("__s"))
    return df.crossJoin(F.broadcast(facts)).withColumn("outlier", F.coalesce(F.abs(r - F.col("__m")) > k * F.col("__s"), F.lit(False))).drop("__m", "__s")


def elements(df: DataFrame, value: str, places: list[int]) -> list:
    """The values at these places (from 0) of the sorted column, nulls left out; None beyond its end. Equal values are counted
    first; running sums over ranges of the distinct ones find the places, so that no task sees all of them."""
    from lithos.operators.order import prefix

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = prefix(counts, ["v"], "n", out="upto")
    inside = F.exists(F.array(*map(F.lit, places)), lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))
    found = run.where(inside).select("v", "n", "upto").collect()  # as many rows as places at most
    return [next((r.v for r in found if r.upto - r.n <= i < r.upto), None) for i in places]


def percentile_band(df: DataFrame, values: list[str], p: float) -> DataFrame:
    """Rows whose every value lies between the sorted values at round(p * n) and round((1 - p) * n) - 1 (from 0)."""
    n = df.count()
    at = [math.floor(p * n + 0.5), math.floor((1 - p) * n + 0.5) - 1]
    if not n or at[1] < at[0]:
        return df.limit(0)
    inside = F.lit(True)
    for v in values:
        lo, hi = elements(df, v, at)
        inside = inside & F.col(v).between(F.lit(lo), F.lit(hi))
    return df.where(inside)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def grouped_quantile(counts: DataFrame, by, order: str, cnt: str, q: float) -> DataFrame:
    """Position of a quantile in bracketed counts: the bracket's number from 0 plus the part of it below the quantile.
    A quantile on an edge belongs to the bracket below; the upper end is the last bracket plus 0.9999."""
    keys = keys_of(by)
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(order)
    run = counts.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.col(cnt).cast("double").alias("c"), F.sum(cnt).over(w).cast("double").alias("upto"), F.sum(cnt).over(Window.partitionBy(*keys, F.lit(0))).cast("double").alias("n"))
    hit = run.where((F.col("c") > 0) & (F.col("upto") >= F.lit(q) * F.col("n"))).groupBy(*keys).agg(F.min(F.struct("i", "c", "upto", "n")).alias("h"))
    part = (F.lit(q) * F.col("h.n") - (F.col("h.upto") - F.col("h.c"))) / F.col("h.c")
    return hit.select(*keys, (F.col("h.i") + (part if q < 1 else F.lit(0.9999))).alias("position"))


def rollup_or_null(df: DataFrame, parent: str, value: str) -> DataFrame:
    """Sum by parent; null if any member's value is missing."""
    missing = F.count(F.lit(1)) > F.count(value)
    return df.groupBy(parent).agg(F.when(~missing, F.sum(value)).alias("total"), F.count(F.lit(1)).alias("members"))


def weighted_crosstab(df: DataFrame, rows, columns, value: str, weight: str) -> DataFrame:
    """Weighted mean and weight for each pair of categories, with sub-totals (null categories mark them)."""
    keys = [*keys_of(rows), *keys_of(columns)]
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return df.cube(*keys).agg(F.grouping_id().alias("level"), F.sum(weight).alias("weight"), mean.alias("mean"))


def r_squared(df: DataFrame, actual: str, predicted: str, by=None) -> DataFrame:
    """1 - residual / total sum of squares."""
    keys = keys_of(by)
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg((1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"))


#: Fits with two parameters: how x and y are changed to make them linear, and whether b is changed back by exp.
SHAPES = {"linear": (lambda x: x, lambda y: y, False), "log": (lambda x: F.log1p(x), lambda y: y, False), "exp": (lambda x: x, lambda y: F.log1p(y), False), "pow": (lambda x: F.ln(x), lambda y: F.ln(y), True)}


def fit(df: DataFrame, x: str, y: str, shape: str = "linear", by=None) -> DataFrame:
    """a, b and r2 (in the linear space) of y = a x + b, a log(x + 1) + b, exp(a x + b) - 1 or b x^a by least squares."""
    fx, fy, back = SHAPES[shape]
    u, v = fx(F.col(x)), fy(F.col(y))
    b = F.regr_intercept(v, u)
    return df.groupBy(*keys_of(by)).agg(F.regr_slope(v, u).alias("a"), (F.exp(b) if back else b).alias("b"), F.regr_r2(v, u).alias("r2"))


def fit_polynomial(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, the highest power first, from one pass of moments and the normal equations."""
    import numpy as np

    mean, sd = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if mean is None:
        return []
    u = (F.col(x) - mean) / (sd or 1.0)
    power = lambda k: F.pow(u, F.lit(float(k)))
    row = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*(F.sum(power(k)) for k in range(2 * degree + 1)), *(F.sum(power(k) * F.col(y)) for k in range(degree + 1))).first()
    s, t = row[: 2 * degree + 1], row[2 * degree + 1 :]
    c = np.linalg.lstsq(np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), np.array(t), rcond=None)[0]
    whole = np.poly1d(c[::-1])(np.poly1d([1 / (sd or 1.0), -mean / (sd or 1.0)]))
    return [0.0] * (degree + 1 - len(whole.coeffs)) + whole.coeffs.tolist()


def weighted_quintiles(df: DataFrame, value: str, weight: str, parts: int = 5) -> DataFrame:
    """Weighted means of the buckets that the running share of weight makes of the sorted rows."""
    w = Window.orderBy(value)
    total = df.agg(F.sum(weight).alias("__w"))
    # sums of equal values first: the running sum then passes distinct values only
    run = df.groupBy(value).agg(F.sum(weight).alias("w")).crossJoin(F.broadcast(total)).withColumn("upto", F.sum("w").over(w))
    bucket = F.least(F.floor((F.col("upto") - F.col("w") / 2) / F.col("__w") * parts), F.lit(parts - 1)).cast("int")
    return run.groupBy(bucket.alias("bucket")).agg(F.sum("w").alias("weight"), F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("mean"))


def harmonic_evidence(df: DataFrame, likelihood: str, by=None) -> DataFrame:
    """Number of samples over the sum of their inverse likelihoods."""
    return df.groupBy(*keys_of(by)).agg(F.try_divide(F.count(likelihood).cast("double"), F.sum(1 / F.col(likelihood))).alias("evidence"))


def convergence(before: DataFrame, after: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Largest, mean and weighted mean relative change of a value between two iterations."""
    joined = after.join(before.select(*keys, F.col(value).alias("__old")), keys)
    change = F.abs(F.col(value) - F.col("__old")) / F.greatest(F.abs(F.col("__old")), F.lit(1e-12))
    w = F.col(weight) if weight else F.lit(1.0)
    return joined.agg(F.max(change).alias("largest"), F.avg(change).alias("mean"), F.try_divide(F.sum(change * w), F.sum(w)).alias("weighted"))


def merged_totals(parts: list[DataFrame], regions: DataFrame) -> DataFrame:
    """region, category, total over several models' tables (region, category, value), for the regions (one column) that are
    asked for; a category that only one of them knows counts as it is."""
    both = parts[0].select("region", "category", "value")
    for more in parts[1:]:
        both = both.unionByName(more.select("region", "category", "value"))
    asked = regions.select(F.col(regions.columns[0]).alias("region"))
    return both.groupBy("region", "category").agg(F.sum("value").alias("total")).join(asked, "region", "left_semi")
