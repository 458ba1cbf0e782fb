"""Bins, classes and clusters of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.order import prefix
from lithos.operators.stats import keys_of, upper_median


def equal_count_bins(df: DataFrame, value: str, n: int, order: list | None = None, by=None) -> DataFrame:
    """`df` with `bin`: of the sorted rows, floor(rows / n) in each bin and the rest in the last one."""
    keys = keys_of(by)
    ranked = prefix(df, [value, *(order or [])], by=keys, out="__rank")
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(counts, keys) if keys else ranked.crossJoin(F.broadcast(counts))
    size = F.greatest(F.floor(F.col("__n") / n), F.lit(1))
    return joined.withColumn("bin", F.least(F.floor((F.col("__rank") - 1) / size), F.lit(n - 1)).cast("int")).drop("__rank", "__n")


def equal_range_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """`df` with `bin`: equal widths over the column's range, the upper end in the last one."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.nullif((F.col("__hi") - F.col("__lo")) / n, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(0)), F.lit(n - 1)).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col(value).isNotNull(), at)).drop("__lo", "__hi")


def break_class(v: Column, breaks: list[float]) -> Column:
    """Number of breaks that a value is not below."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in breaks)), lambda b: b <= v))


def binned_upper_median(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Centre of each bin of x that has rows, and the upper median of y in it."""
    at = F.floor(F.col(x) / width)
    out = df.where(F.col(x).isNotNull()).groupBy(at.alias("bin")).agg(upper_median(y).alias("median"), F.count(y).alias("n"))
    return out.select("bin", ((F.col("bin") + 0.5) * width).alias("centre"), "median", "n")


def kmeans_1d(df: DataFrame, value: str, k: int, rounds: int = 20, log: bool = False) -> tuple[DataFrame, list[float]]:
    """`df` with `cluster`, numbered by centre, and the centres. Starts from evenly spaced ranks of the values; an empty
    cluster keeps its centre. Only k numbers a round come to the driver."""
    v = F.log1p(value) if log else F.col(value).cast("double")
    ranks = [(i + 0.5) / k for i in range(k)]
    centres = df.select(F.percentile(v, F.array(*map(F.lit, ranks))).alias("c")).first().c
    if centres is None:
        return df.withColumn("cluster", F.lit(None).cast("int")), []
    for _ in range(rounds):
        near = nearest(v, centres)
        rows = df.where(v.isNotNull()).groupBy(near.alias("c")).agg(F.avg(v).alias("m")).collect()
        new = list(centres)
        for r in rows:
            new[r.c] = r.m
        new.sort()
        if new == centres:
            break
        centres = new
    return df.withColumn("cluster", F.when(v.isNotNull(), nearest(v, centres))), centres


def nearest(v: Column, centres: list[float]) -> Column:
    """Number of the nearest of sorted centres, the first of two."""
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return F.size(F.filter(F.array(*map(F.lit, mids)), lambda m: m < v)) if mids else F.lit(0)


def kmeans(df: DataFrame, ident: str, vector: str, k: int, rounds: int = 50) -> DataFrame:
    """ident, cluster, distance: k-means of vectors of one length. Starts from ident modulo k (a hash of it, if it is no whole
    number); stops when no centre
    moves; an empty cluster keeps its centre. k centres come to the driver each round; the vectors never do."""
    from lithos.functions.geo import vector_distance

    rows = df.where(F.col(vector).isNotNull()).select(ident, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    number = F.col(ident) if dict(rows.dtypes)[ident] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(ident)
    start = rows.select("v", F.pmod(number, F.lit(k)).cast("int").alias("c"))
    centres = means(start)
    for _ in range(rounds):
        new = centres | means(rows.select("v", closest(F.col("v"), centres).alias("c")))
        if all(max(abs(a - b) for a, b in zip(new[c], centres[c])) < 1e-12 for c in new):
            break
        centres = new
    if not centres:
        return rows.select(ident, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    c = closest(F.col("v"), centres)
    table = F.array(*(F.array(*map(F.lit, centres[i])) if i in centres else F.lit(None).cast("array<double>") for i in range(k)))
    return rows.select(ident, c.alias("cluster"), vector_distance(F.col("v"), F.get(table, c)).alias("distance"))


def means(rows: DataFrame) -> dict[int, list[float]]:
    """Mean vector of each cluster, summed by position so that partial sums meet before the shuffle."""
    parts = rows.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("m"))
    out: dict[int, dict[int, float]] = {}
    for r in parts.collect():
        out.setdefault(r.c, {})[r.i] = r.m
    return {c: [m[i] for i in sorted(m)] for c, m in out.items()}


def closest(v: Column, centres: dict[int, list[float]]) -> Column:
    from lithos.functions.geo import vector_distance

    return F.array_min(F.array(*(F.struct(vector_distance(v, F.array(*map(F.lit, m))).alias("d"), F.lit(c).alias("c")) for c, m in sorted(centres.items()))))["c"]


def classify(df: DataFrame, value: str, k: int, method: str, order: list | None = None) -> DataFrame:
    """`df` with `class` from 0 by one of kmeans, log_kmeans, equal_count and equal_range. Equal values share the lowest of
    their classes under equal_count."""
    if method in ("kmeans", "log_kmeans"):
        out, _ = kmeans_1d(df, value, k, log=method == "log_kmeans")
        return out.withColumnRenamed("cluster", "class")
    if method == "equal_range":
        return equal_range_bins(df, value, k).withColumnRenamed("bin", "class")
    if method == "equal_count":
        binned = equal_count_bins(df, value, k, order)
        low = binned.groupBy(value).agg(F.min("bin").alias("class"))
        return binned.drop("bin").join(low, value)
    raise ValueError(method)


def class_statistics(df: DataFrame, value: str, cls: str = "class") -> DataFrame:
    return df.groupBy(cls).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
