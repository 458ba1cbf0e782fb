"""Ranks, running sums and samples over a total order of a whole table, without a task that sees all rows.

Rows are dealt by ranges of the order; each range is ranked on its own and moved up by what the ranges before it hold,
one number a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators.stats import keys_of
from lithos.scratch import Scratch


def prefix(df: DataFrame, order: list, value: str | None = None, by=None, out: str = "rank") -> DataFrame:
    """`df` with `out`: the row's rank from 1 in `order`, within its group; or the running sum of `value` up to the row.
    `order` should be total: rows that tie come in any order, but always get different ranks."""
    spark, keys = df.sparkSession, keys_of(by)
    scratch = Scratch(spark, "order")
    whole = [F.col(c).asc_nulls_first() for c in keys] + [c if isinstance(c, Column) else F.col(c).asc() for c in order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(ranges, *whole).withColumn("__range", F.spark_partition_id()))
    one = F.lit(1) if value is None else F.col(value)
    sums = {r["__range"]: r.s or 0 for r in dealt.groupBy("__range").agg(F.sum(one).alias("s")).collect()}
    before, total = {}, 0
    for k in sorted(sums):
        before[k], total = total, total + sums[k]
    here = F.sum(one).over(Window.partitionBy("__range").orderBy(*whole).rowsBetween(Window.unboundedPreceding, 0))
    up = F.create_map(*(x for k, v in before.items() for x in (F.lit(k), F.lit(v)))) if before else None
    ranked = dealt.withColumn(out, here + F.coalesce(up[F.col("__range")], F.lit(0)) if before else here).drop("__range")
    if not keys:
        return ranked
    first = F.min(F.col(out) - (F.lit(1) if value is None else F.coalesce(F.col(value), F.lit(0)))).alias("__first")
    ranked = scratch.save(ranked)
    starts = ranked.groupBy(*keys).agg(first)
    for k in keys:
        starts = starts.withColumnRenamed(k, f"__{k}")
    same = F.lit(True)
    for k in keys:
        same = same & ranked[k].eqNullSafe(starts[f"__{k}"])
    return ranked.join(starts, same).withColumn(out, F.col(out) - F.col("__first")).drop("__first", *(f"__{k}" for k in keys))


def seeded(seed: int, *ident) -> list:
    """An order that looks random and is the same for the same rows: a hash of the seed and the row's id, then the id."""
    return [F.xxhash64(F.lit(seed), *ident), *ident]


def kth_best(df: DataFrame, order: list, k: int) -> DataFrame:
    """The row of rank k: a top-k by task, then of those."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") == k)


def shuffled(df: DataFrame, seed: int, *ident) -> DataFrame:
    return df.orderBy(*seeded(seed, *ident))


def sample(df: DataFrame, n: int, seed: int, *ident) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(*seeded(seed, *ident)).limit(n)


def partition(df: DataFrame, parts: int, seed: int, *ident, out: str = "part") -> DataFrame:
    """`df` dealt to `parts` parts whose sizes differ by one at most."""
    return prefix(df, seeded(seed, *ident), out="__r").withColumn(out, F.pmod(F.col("__r") - 1, F.lit(parts)).cast("int")).drop("__r")


def folds(df: DataFrame, k: int, seed: int, *ident) -> DataFrame:
    """Each row once a fold (from 0), with `test`: whether it is among that fold's test rows."""
    parts = partition(df, k, seed, *ident, out="__part")
    every = parts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.withColumn("test", F.col("fold") == F.col("__part")).drop("__part")


def bootstrap(df: DataFrame, seed: int, *ident) -> DataFrame:
    """`df` with `times`: how often a row is drawn when as many rows as there are are drawn with replacement; 0 marks those
    out of the bag. Draws are row numbers, so that each is found by a join."""
    ranked = Scratch(df.sparkSession, "bootstrap").save(prefix(df, seeded(seed, *ident), out="__r"))
    n = ranked.count()
    draws = df.sparkSession.range(n).select((F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(max(n, 1))) + 1).alias("__r"))
    drawn = draws.groupBy("__r").agg(F.count(F.lit(1)).alias("times"))
    return ranked.join(drawn, "__r", "left").withColumn("times", F.coalesce("times", F.lit(0))).drop("__r")


def cumulative_threshold(df: DataFrame, order: list, value: str, least: float) -> DataFrame:
    """The first row at which the running sum of `value` reaches `least`."""
    run = prefix(df, order, value, out="upto")
    return run.where(F.col("upto") >= least).orderBy("upto", *order).limit(1)


def is_sorted(df: DataFrame, order: list, value: str) -> DataFrame:
    """`sorted`: whether `value` never falls along `order`: each value is compared to the one before in its range and at
    the seams."""
    ranked = prefix(df, order, out="__r")
    ahead = ranked.select((F.col("__r") + 1).alias("__r"), F.col(value).alias("__before"))
    return ranked.join(ahead, "__r").agg(F.coalesce(F.bool_and(F.col(value) >= F.col("__before")), F.lit(True)).alias("sorted"))
