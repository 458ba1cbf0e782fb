"""Choice and trip models: logit shares, gravity, balancing, successive averages, allocation. OD tables are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.stats import convergence, keys_of, shares
from lithos.scratch import Scratch


def logit_split(costs: DataFrame, by, cost: str, scale: float, out: str = "p") -> DataFrame:
    """Shares exp(-cost / scale) within each group, taken from the group's least cost on; null costs have share 0, groups of
    null costs only have null shares."""
    keys = keys_of(by)
    low = costs.groupBy(*keys).agg(F.min(cost).alias("__low"))
    w = costs.join(low, keys).withColumn("__w", F.coalesce(F.exp(-(F.col(cost) - F.col("__low")) / scale), F.lit(0.0)))
    return _over(w, keys, out)


def _over(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    total = rows.groupBy(*keys).agg(F.sum("__w").alias("__t"))
    return rows.join(total, keys).withColumn(out, F.try_divide(F.col("__w"), F.nullif("__t", F.lit(0.0)))).drop("__w", "__t", "__low")


def nested_split(costs: DataFrame, by, nest: str, option: str, cost: str, scale: float, inner: float) -> DataFrame:
    """Shares of options in nests: nests compete by their least cost, options within them by theirs."""
    keys = keys_of(by)
    best = logit_split(costs.groupBy(*keys, nest).agg(F.min(cost).alias("__c")), keys, "__c", scale, "__pn").drop("__c")
    within = logit_split(costs, [*keys, nest], cost, inner, "__po")
    return within.join(best, [*keys, nest]).withColumn("p", F.col("__pn") * F.col("__po")).drop("__pn", "__po")


def gravity(od: DataFrame, scale: float, cost: str = "cost", activity: str = "activity") -> DataFrame:
    """`od` (origin, dest, cost, activity of the destination) with p: activity * exp(-cost / scale) over its origin's sum;
    uniform where that is 0."""
    w = od.withColumn("__w", F.coalesce(F.col(activity) * F.exp(-F.col(cost) / scale), F.lit(0.0)))
    return shares(w, "__w", "origin", "p").drop("__w")


def gravity_by_distance(od: DataFrame) -> DataFrame:
    """`od` (origin, dest, dist, mass_o, mass_d) with trips mass_o * (mass_d / dist) / sum; no trips to the origin itself."""
    w = od.where("origin <> dest").withColumn("__w", F.try_divide(F.col("mass_d"), F.col("dist")))
    total = w.groupBy("origin").agg(F.sum("__w").alias("__t"))
    return w.join(total, "origin").withColumn("trips", F.col("mass_o") * F.try_divide(F.col("__w"), F.col("__t"))).drop("__w", "__t")


def balanced(od: DataFrame, targets: DataFrame, error: float = 0.1, rounds: int = 50) -> DataFrame:
    """origin, dest, p, factor: gravity shares (origin, dest, trips, w) whose destinations are scaled by target / actual until
    each sum is within `error` of its target (dest, target); half the step once ten rounds haven't been enough."""
    scratch = Scratch(od.sparkSession, "balance")
    base = scratch.save(od.select("origin", "dest", "trips", "w"))
    factor = scratch.save(targets.select("dest", "target", F.lit(1.0).alias("factor")))
    for k in range(rounds + 1):
        scaled = base.join(factor, "dest").withColumn("__v", F.col("w") * F.col("factor"))
        now = scratch.save(shares(scaled, "__v", "origin", "p").drop("__v"))
        actual = now.groupBy("dest").agg(F.sum(F.col("trips") * F.col("p")).alias("actual"))
        ratio = scratch.save(factor.join(actual, "dest").withColumn("ratio", F.coalesce(F.try_divide(F.col("target"), F.col("actual")), F.lit(1.0))))
        worst = ratio.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0]
        if worst is None or worst < error or k == rounds:
            break
        step = F.col("ratio") if k < 10 else F.sqrt("ratio")
        factor = scratch.save(ratio.select("dest", "target", (F.col("factor") * step).alias("factor")))
    return now.select("origin", "dest", "trips", "p", "factor")


def successive_averages(start: DataFrame, respond, keys: list[str], value: str, tolerance: float = 0.02, least: int = 4, most: int = 12) -> tuple[DataFrame, int]:
    """Fixed point of respond(table) by successive averages: x + (y - x) / (n + 1); ends when the largest relative change is
    below the tolerance after at least `least` rounds, an even number of them. The table and the number of rounds."""
    scratch = Scratch(start.sparkSession, "averages")
    now, n = scratch.save(start.select(*keys, value)), 0
    while n < most:
        n += 1
        new = respond(now).select(*keys, F.col(value).alias("__y"))
        after = scratch.save(now.join(new, keys).select(*keys, (F.col(value) + (F.col("__y") - F.col(value)) / (n + 1)).alias(value)))
        change = convergence(now, after, keys, value).first().largest
        now = after
        if n >= least and n % 2 == 0 and (change or 0) < tolerance:
            break
    return now, n


def combined(parts: list[tuple[DataFrame, float]], keys: list[str], value: str) -> DataFrame:
    """Weighted sum of tables with the same keys."""
    both = None
    for df, w in parts:
        one = df.select(*keys, (F.col(value) * w).alias(value))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def generalised_cost(wait: Column, walk: Column, ride: Column, fare: Column, value_of_time: float, weights=(2.0, 2.0, 1.0)) -> Column:
    return (wait * weights[0] + walk * weights[1] + ride * weights[2]) * value_of_time + fare


def attracted(od: DataFrame) -> DataFrame:
    """Trips that each destination draws."""
    return od.groupBy("dest").agg(F.sum(F.col("trips") * F.col("p")).alias("trips"))


def within_budget(od: DataFrame, budgets: list[float], activity: str = "activity", cost: str = "cost") -> DataFrame:
    """Activities that each origin reaches under each budget."""
    return od.groupBy("origin").agg(*(F.sum(F.when(F.col(cost) <= b, F.col(activity)).otherwise(0.0)).alias(f"within_{i}") for i, b in enumerate(budgets)))


def overlap_satisfaction(actual: DataFrame, desired: DataFrame, keys: list[str], value: str, by=None) -> DataFrame:
    """Sum of min(actual, desired) over the sum of actual, by zone or in all."""
    both = actual.select(*keys, F.col(value).alias("__a")).join(desired.select(*keys, F.col(value).alias("__d")), keys, "full")
    a, d = (F.coalesce(c, F.lit(0.0)) for c in ("__a", "__d"))
    return both.groupBy(*keys_of(by)).agg(F.try_divide(F.sum(F.least(a, d)), F.sum(a)).alias("satisfaction"))


def balance_table(cells: DataFrame, rows: DataFrame, columns: DataFrame, rounds: int = 20) -> DataFrame:
    """r, c, v fitted to row (r, total) and column (c, total) sums by turns."""
    scratch = Scratch(cells.sparkSession, "ipf")
    now = scratch.save(cells.select("r", "c", F.col("v").cast("double").alias("v")))
    for k in range(rounds):
        for key, totals in (("r", rows), ("c", columns)):
            sums = now.groupBy(key).agg(F.sum("v").alias("__s")).join(totals, key)
            now = now.join(sums, key).select("r", "c", F.coalesce(F.col("v") * F.try_divide(F.col("total"), F.col("__s")), F.lit(0.0)).alias("v"))
        now = scratch.save(now)
    return now


def household_rows(counts: DataFrame, keys: list[str], cnt: str) -> DataFrame:
    """One row for each of a count, numbered from 1."""
    return counts.where(F.col(cnt) > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.col(cnt).cast("int")))).select(*keys, "n")


def bracket_incomes(counts: DataFrame, zone: str, lo: str, hi: str, cnt: str) -> DataFrame:
    """Mean and median income by zone, with counts spread evenly inside their brackets."""
    spread = counts.where(F.col(cnt) > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(cnt).cast("int"))))
    income = F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col("__i") - 0.5) / F.col(cnt)
    return spread.groupBy(zone).agg(F.avg(income).alias("mean"), F.median(income).alias("median"))


def cars_from_bands(none: Column, one: Column, two: Column, more: Column) -> Column:
    """Cars per household of banded counts: a third of the open band has four cars; null for 9 households or fewer."""
    n = none + one + two + more
    return F.when(n > 9, (one + 2 * two + 3 * more * 2 / 3 + 4 * more / 3) / n)


def rescaled_population(zones: DataFrame, population: str, dwellings: str) -> DataFrame:
    """Population shared out by the zones' dwellings, missing ones as 0."""
    d = zones.withColumn(dwellings, F.coalesce(dwellings, F.lit(0)))
    total = d.agg(F.sum(population).alias("__p"), F.sum(dwellings).alias("__d"))
    return d.crossJoin(F.broadcast(total)).withColumn("scaled", F.try_divide(F.col(dwellings) * F.col("__p"), F.col("__d"))).drop("__p", "__d")


def tolled_cost(distance: Column, per_km: float, parking: Column, zone_charge: Column) -> Column:
    """Operating cost of a car trip with parking and a congestion charge."""
    return distance * per_km + F.coalesce(parking, F.lit(0.0)) + F.coalesce(zone_charge, F.lit(0.0))


def allocated(households: DataFrame, stock: DataFrame, desire: DataFrame, seed: int, bands: int = 10) -> DataFrame:
    """band, zone, dwelling, housed: households (hh, income) fill the stock (zone, dwelling, free), the richest first, by
    their income band's desire (band, zone, dwelling, weight), in proportion to weight * free. Bands take turns, so what is
    left is known to the next; within a band all are housed at once."""
    from lithos.operators.order import prefix

    scratch = Scratch(households.sparkSession, "allocate")
    ranked = prefix(households, [F.desc("income"), F.xxhash64(F.lit(seed), "hh"), F.col("hh")], out="rank")
    n = households.count()
    of = ranked.withColumn("band", F.floor((F.col("rank") - 1) * bands / max(n, 1)).cast("int")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    of = {r.band: r.n for r in of.collect()}
    free, out = scratch.save(stock.select("zone", "dwelling", F.col("free").cast("double").alias("free"))), None
    for band in sorted(of):
        left = float(of[band])
        for _ in range(8):  # what a full dwelling type can't take goes to the others
            w = free.join(desire.where(F.col("band") == band), ["zone", "dwelling"]).withColumn("__w", F.col("weight") * F.col("free"))
            given = shares(w, "__w", None, "__p").select("zone", "dwelling", "free", F.least(F.col("__p") * left, F.col("free")).alias("housed"), F.lit(band).alias("band"))
            given = scratch.save(given.where("housed > 0"))
            used = given.agg(F.sum("housed")).first()[0] or 0.0
            out = given.drop("free") if out is None else out.union(given.drop("free"))
            free = scratch.save(free.join(given.select("zone", "dwelling", "housed"), ["zone", "dwelling"], "left").select("zone", "dwelling", (F.col("free") - F.coalesce("housed", F.lit(0.0))).alias("free")))
            left -= used
            if left < 1e-6 or used < 1e-9:
                break
    return out.groupBy("band", "zone", "dwelling").agg(F.sum("housed").alias("housed"))
