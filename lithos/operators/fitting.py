"""Searches for the model that fits a table best. A model is an array of parameters, its misfit the mean of an expression over
all rows of the table. All candidates of a round are evaluated together, by one aggregate over the table; chains and members
of a population are rows, which a round changes by joins. Draws are hashes, so that reruns agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.trees import uniform
from lithos.scratch import Scratch

#: Candidates of one round: they are a constant of the aggregate's plan. A round with more is refused.
MOST = 10_000

Bounds = list[tuple[float, float]]


def drawn_models(spark: SparkSession, bounds: Bounds, n: int, seed: int) -> DataFrame:
    """id, params: n models uniform within the bounds."""
    params = F.array(*(F.lit(float(a)) + uniform(seed, F.col("id"), d) * F.lit(float(b - a)) for d, (a, b) in enumerate(bounds)))
    return spark.range(n).select("id", params.alias("params"))


def misfits(models: DataFrame, table: DataFrame, error: Callable[[Column], Column]) -> DataFrame:
    """`models` (id, params, ...) with misfit: the mean of error(params) over the rows of `table`; null for an empty table. A
    row of the table meets every model in its own task, and tasks hand on one sum a model."""
    some = models.select("id", "params").limit(MOST + 1).collect()
    if len(some) > MOST:
        raise ValueError(f"more than {MOST} models in a round")
    constant = F.from_json(F.lit(json.dumps([{"id": r.id, "params": list(r.params)} for r in some])), "array<struct<id:long,params:array<double>>>")
    each = table.withColumn("__m", F.explode(constant))
    found = each.groupBy(F.col("__m.id").alias("id")).agg(F.avg(error(F.col("__m.params"))).alias("misfit"))
    return models.join(found, "id", "left")


def monte_carlo(spark: SparkSession, table: DataFrame, error, bounds: Bounds, n: int, seed: int) -> DataFrame:
    """id, params, misfit of n drawn models."""
    return misfits(drawn_models(spark, bounds, n, seed), table, error)


def annealing(spark: SparkSession, table: DataFrame, error, bounds: Bounds, chains: int, steps: int, hot: float, cold: float, seed: int) -> DataFrame:
    """id, params, misfit of each chain's last model. In a step every chain moves one axis anywhere within its bounds; what is
    better is taken, and what is worse with the chance of Metropolis at a temperature that falls geometrically."""
    scratch = Scratch(spark, "annealing")
    table = scratch.save(table)
    now = scratch.save(monte_carlo(spark, table, error, bounds, chains, seed))
    low, width = (F.array(*(F.lit(float(x)) for x in xs)) for xs in ([a for a, _ in bounds], [b - a for a, b in bounds]))
    for k in range(steps):
        heat = hot * (cold / hot) ** (k / max(1, steps - 1))
        axis = F.floor(uniform(seed, "axis", k, F.col("id")) * len(bounds)).cast("int")
        to = uniform(seed, "to", k, F.col("id"))
        moved = F.transform("params", lambda x, d: F.when(d == axis, F.get(low, d) + to * F.get(width, d)).otherwise(x))  # noqa: B023
        tried = misfits(now.select("id", moved.alias("params")), table, error).select("id", F.col("params").alias("new"), F.col("misfit").alias("then"))
        both = now.join(tried, "id")
        taken = (F.col("then") < F.col("misfit")) | (uniform(seed, "taken", k, F.col("id")) < F.exp(-(F.col("then") - F.col("misfit")) / F.lit(heat)))
        now = scratch.save(both.select("id", F.when(taken, F.col("new")).otherwise(F.col("params")).alias("params"), F.when(taken, F.col("then")).otherwise(F.col("misfit")).alias("misfit")))
    return now


def genetic(spark: SparkSession, table: DataFrame, error, bounds: Bounds, population: int, generations: int, mutation: float, seed: int) -> DataFrame:
    """id, params, misfit of the last population. In a generation every member meets a drawn mate; each gene is of one of them
    and changed by up to `mutation` of its axis' width; the child takes the member's place if it fits better."""
    scratch = Scratch(spark, "genetic")
    table = scratch.save(table)
    now = scratch.save(monte_carlo(spark, table, error, bounds, population, seed))
    for g in range(generations):
        mate = F.floor(uniform(seed, "mate", g, F.col("id")) * population).cast("long").alias("mate")
        other = now.select(F.col("id").alias("mate"), F.col("params").alias("other"))

        def gene(d):
            mixed = F.when(uniform(seed, "gene", g, F.col("id"), d) < 0.5, F.get("params", F.lit(d))).otherwise(F.get("other", F.lit(d)))  # noqa: B023
            low, high = map(float, bounds[d])
            noise = (uniform(seed, "noise", g, F.col("id"), d) - 0.5) * F.lit(2 * mutation * (high - low))  # noqa: B023
            return F.least(F.greatest(mixed + noise, F.lit(low)), F.lit(high))

        child = now.withColumn("mate", mate).join(other, "mate").select("id", F.array(*map(gene, range(len(bounds)))).alias("params"))
        tried = misfits(child, table, error).select("id", F.col("params").alias("new"), F.col("misfit").alias("then"))
        fitter = F.col("then") < F.col("misfit")
        now = scratch.save(now.join(tried, "id").select("id", F.when(fitter, F.col("new")).otherwise(F.col("params")).alias("params"), F.when(fitter, F.col("then")).otherwise(F.col("misfit")).alias("misfit")))
    return now


def gradient(models: DataFrame, table: DataFrame, error, dims: int, h: float = 1e-3) -> DataFrame:
    """`models` (id, params) with gradient: central differences, all 2 * dims evaluations of all models in one aggregate."""
    ways = F.sequence(F.lit(0), F.lit(2 * dims - 1))
    step = F.when(F.col("way") % 2 == 1, F.lit(h)).otherwise(F.lit(-h))
    moved = models.withColumn("way", F.explode(ways)).select((F.col("id") * 2 * dims + F.col("way")).alias("id"), F.transform("params", lambda x, d: x + F.when(d == F.floor(F.col("way") / 2), step).otherwise(0.0)).alias("params"))
    found = misfits(moved, table, error).select(F.floor(F.col("id") / (2 * dims)).alias("id"), F.pmod("id", F.lit(2 * dims)).cast("int").alias("way"), "misfit")
    by = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("way", "misfit"))).alias("f"))
    slope = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.try_element_at("f", 2 * d + 1) - F.try_element_at("f", 2 * d)) / (2 * h))
    return models.join(by, "id").withColumn("gradient", slope).drop("f")


def line_statistics(table: DataFrame, x: Column, y: Column) -> dict:
    """What the mean squared error of every line through (x, y) depends on, in one aggregate."""
    row = table.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(x * x).alias("xx"), F.avg(x * y).alias("xy"), F.avg(y * y).alias("yy")).first()
    return {k: v or 0.0 for k, v in row.asDict().items()}


def line_error(s: dict) -> Callable:
    """The mean squared error of lines (intercept, slope), a row each, from line_statistics()."""
    def error(p):
        a, b = p[:, 0], p[:, 1]
        return s["yy"] - 2 * a * s["y"] - 2 * b * s["xy"] + a * a + 2 * a * b * s["x"] + b * b * s["xx"]

    return error
