"""Marginal densities of model parameters as histograms (dim, bin, cnt) with bounds (dim, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marginals(models: DataFrame, bounds: list[tuple[float, float]], bins: int, params: str = "params", weight: str | None = None) -> DataFrame:
    """dim, bin, cnt: each parameter's histogram within its bounds, empty bins too; the upper bound is in the last bin."""
    spark = models.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bounds)], "dim int, lo double, hi double")
    long = models.select(F.posexplode(params).alias("dim", "x"), (F.col(weight) if weight else F.lit(1)).alias("w")).join(F.broadcast(table), "dim")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = long.where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy("dim", at.alias("bin")).agg(F.sum("w").alias("cnt"))
    every = table.select("dim", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, ["dim", "bin"], "left").select("dim", "bin", edge.alias("edge"), ((F.col("hi") - F.col("lo")) / bins).alias("width"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Histograms over the same bins, added."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("dim", "bin", "edge", "width").agg(F.sum("cnt").alias("cnt"))


def probabilities(hist: DataFrame) -> DataFrame:
    """p and density of each bin. A dimension's bins are few, whatever the number of models."""
    p = F.try_divide(F.col("cnt"), F.sum("cnt").over(Window.partitionBy("dim")))
    return hist.withColumn("p", p).withColumn("density", F.col("p") / F.col("width"))


def modes(hist: DataFrame) -> DataFrame:
    """dim and the centre of its fullest bin, the first of several."""
    return hist.groupBy("dim").agg(F.max(F.struct("cnt", -F.col("bin"), (F.col("edge") + F.col("width") / 2).alias("mode"))).alias("m")).select("dim", "m.mode")


def confidence(hist: DataFrame, p: float) -> DataFrame:
    """dim, lo, hi: the quantiles (1 - p) / 2 and (1 + p) / 2 of each marginal, linear within bins."""
    w = Window.partitionBy("dim").orderBy("bin")
    run = probabilities(hist).withColumn("upto", F.sum("p").over(w))
    def quantile(q):
        at = F.min(F.when((F.col("upto") >= q) & (F.col("p") > 0), F.struct("bin", (F.col("edge") + F.col("width") * (q - (F.col("upto") - F.col("p"))) / F.col("p")).alias("x"))))
        return at["x"]
    return run.groupBy("dim").agg(quantile((1 - p) / 2).alias("lo"), quantile((1 + p) / 2 - 1e-12).alias("hi"))


def rescaled(hist: DataFrame, dim: int, lo: float, hi: float, bins: int) -> DataFrame:
    """A marginal over other bounds: old bins give to new ones what they overlap, in proportion."""
    spark = hist.sparkSession
    width = (hi - lo) / bins
    new = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (lo + F.col("id") * width).alias("edge"))
    old = hist.where(F.col("dim") == dim).select(F.col("edge").alias("a"), (F.col("edge") + F.col("width")).alias("b"), "cnt")
    over = F.greatest(F.lit(0.0), F.least("b", F.col("edge") + width) - F.greatest("a", "edge")) / (F.col("b") - F.col("a"))
    return new.crossJoin(F.broadcast(old)).groupBy("bin", "edge").agg(F.sum(over * F.col("cnt")).alias("cnt")).select(F.lit(dim).alias("dim"), "bin", "edge", F.lit(width).alias("width"), "cnt")


def combined(hist: DataFrame, dims: list[int]) -> DataFrame:
    """Counts of several dimensions' bins, added by bin number."""
    return hist.where(F.col("dim").isin(dims)).groupBy("bin").agg(F.sum("cnt").alias("cnt"))
