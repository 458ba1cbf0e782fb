"""Features and tables made from other columns: planar and rotated coordinates, bands, ratios, matrices, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import geo, maths
from lithos.operators.stats import grouped_quantile, keys_of


def planarised(points: DataFrame) -> DataFrame:
    """`points` (lat, lon) with x, y: metres east and north of the south-west corner of them all."""
    corner = points.agg(F.min("lat").alias("__s"), F.min("lon").alias("__w"))
    at = points.crossJoin(F.broadcast(corner))
    x = geo.haversine(F.col("lat"), F.col("__w"), F.col("lat"), F.col("lon"))
    y = geo.haversine(F.col("__s"), F.col("lon"), F.col("lat"), F.col("lon"))
    return at.withColumns({"x": x, "y": y}).drop("__s", "__w")


def more_bases(points: DataFrame, angles: list[float], x: str = "x", y: str = "y") -> DataFrame:
    """`points` with coordinates in bases turned by each angle (radians): x_1, y_1, ..."""
    turned = {}
    for i, a in enumerate(angles, 1):
        turned[f"{x}_{i}"] = F.col(x) * math.cos(a) + F.col(y) * math.sin(a)
        turned[f"{y}_{i}"] = F.col(y) * math.cos(a) - F.col(x) * math.sin(a)
    return points.withColumns(turned)


def noise(seed: int, *ident) -> Column:
    """Standard normal noise that depends on the seed and the row's id only."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *ident), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))


def jittered(points: DataFrame, columns: dict[str, float], seed: int, *ident) -> DataFrame:
    """Columns moved by normal noise of the given deviations."""
    return points.withColumns({c: F.col(c) + sd * noise(seed + i, *ident) for i, (c, sd) in enumerate(sorted(columns.items()))})


def noisy_surface(points: DataFrame, kind: str, sd: float, seed: int, *ident) -> DataFrame:
    """`points` (lat, lon) with v: a smooth surface plus noise that is gauss, uniform, exponential or mixed (a third each)."""
    u = (F.pmod(F.xxhash64(F.lit(seed + 9), *ident), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    kinds = {"gauss": noise(seed, *ident), "uniform": (u - 0.5) * math.sqrt(12), "exponential": -F.ln(u) - 1}
    pick = F.pmod(F.xxhash64(F.lit(seed + 5), *ident), F.lit(3))
    kinds["mixed"] = F.when(pick == 0, kinds["gauss"]).when(pick == 1, kinds["uniform"]).otherwise(kinds["exponential"])
    return points.withColumn("v", F.sin(F.col("lat") * 4) + F.cos(F.col("lon") * 3) + sd * kinds[kind])


def with_repeats(vector: Column, time: Column, times: int) -> Column:
    """A feature vector with its time repeated, so that splits fall on it more often."""
    return F.concat(vector, F.array_repeat(time, times))


def patched_counts(n: Column, smooth: bool = False) -> Column:
    """Small counts that were blurred for confidentiality: 3 stands for 2; or all counts plus 1."""
    return n + 1 if smooth else F.when(n == 3, 2).otherwise(n)


def merged_brackets(counts: DataFrame, keys: list[str], bracket: str, cnt: str, into: dict[int, int]) -> DataFrame:
    """Counts by bracket with some brackets taken together; others move down to stay dense."""
    to = F.coalesce(F.create_map(*(F.lit(x) for kv in into.items() for x in kv))[F.col(bracket)], F.col(bracket) - (max(into) - max(into.values())))
    return counts.groupBy(*keys, to.alias(bracket)).agg(F.sum(cnt).alias(cnt))


def bracket_median(counts: DataFrame, by, bracket: str, cnt: str, edges: list[float]) -> DataFrame:
    """Median dollars of bracketed counts: brackets are numbered along `edges`, which has one edge more than there are."""
    at = grouped_quantile(counts, by, bracket, cnt, 0.5)
    lo, hi = (F.get(F.array(*map(F.lit, map(float, edges))), F.floor("position").cast("int") + k) for k in (0, 1))
    return at.select(*keys_of(by), (lo + (hi - lo) * (F.col("position") - F.floor("position"))).alias("median"))


def percent(part: Column, whole: Column) -> Column:
    """Percent of a total; null where that isn't above 0."""
    return F.when(whole > 0, 100.0 * part / whole)


def packets(observations: DataFrame) -> DataFrame:
    """sid, packets, observers of each source."""
    return observations.groupBy("sid").agg(F.count(F.lit(1)).alias("packets"), F.count_distinct("rid").alias("observers"))


def totals_of(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sums by key over several models' totals; a key that one lacks counts 0 there."""
    both = tables[0].select(key, value)
    for t in tables[1:]:
        both = both.unionByName(t.select(key, value))
    return both.groupBy(key).agg(F.sum(value).alias(value))


def origin_destination(zones: DataFrame, modes: DataFrame, zone: str = "zone") -> DataFrame:
    """origin, dest, mode and both places of every pair of zones (zone, lat, lon): the zones of a city, as the model needs
    every pair."""
    a, b = (zones.select(F.col(zone).alias(n), F.col("lat").alias(f"lat_{n[0]}"), F.col("lon").alias(f"lon_{n[0]}")) for n in ("origin", "dest"))
    pairs = a.crossJoin(F.broadcast(b)).withColumn("km", geo.haversine(F.col("lat_o"), F.col("lon_o"), F.col("lat_d"), F.col("lon_d")) / 1000)
    return pairs.crossJoin(F.broadcast(modes))


def region_pairs(counts: DataFrame) -> DataFrame:
    """Lines `a b share` of (a, b, n) by their share of a's total."""
    total = counts.groupBy("a").agg(F.sum("n").alias("__t"))
    return counts.join(total, "a").select("a", F.concat_ws(" ", "a", "b", F.round(F.col("n") / F.col("__t"), 6)).alias("value"))


def matrices(a: DataFrame, b: DataFrame, op: str, keys: list[str], value: str = "v") -> DataFrame:
    """Element by element add, sub, mul or div of long matrices; where one has no element the result has none."""
    joined = a.join(b.select(*keys, F.col(value).alias("__o")), keys)
    x, y = F.col(value), F.col("__o")
    return joined.select(*keys, {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[op].alias(value))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """r, c, v of the product of long matrices (r, c, v)."""
    right = b.select(F.col("r").alias("c"), F.col("c").alias("__c"), F.col("v").alias("__v"))
    return a.join(right, "c").groupBy("r", F.col("__c").alias("c")).agg(F.sum(F.col("v") * F.col("__v")).alias("v"))


def not_rectangular(cells: DataFrame) -> DataFrame:
    """Rows (r, c, v) whose number of elements isn't the commonest."""
    sizes = cells.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).agg(F.max(F.struct("k", "n")).alias("u"))
    return sizes.crossJoin(F.broadcast(usual)).where(F.col("n") != F.col("u.n")).select("r", "n")


def log_linear_energy(base: float, income: Column, household: Column, dwelling: Column, by_household: dict, by_dwelling: dict, slope: float, sd: float = 0.0) -> Column:
    """Expected energy of a household: exp of a linear form in income and effects of household and dwelling type, times
    exp(sd^2 / 2) for its log-normal spread."""
    effect = lambda c, t: F.coalesce(F.create_map(*(F.lit(x) for kv in t.items() for x in kv))[c], F.lit(0.0))
    return F.exp(base + slope * income + effect(household, by_household) + effect(dwelling, by_dwelling) + sd * sd / 2)


def ownership(z: Column, cuts: list[float]) -> Column:
    """Expected number of cars of an ordinal model."""
    return F.aggregate(F.transform(maths.ordinal_shares(z, cuts), lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)


def reproduced_choices(scores: DataFrame, chooser: str, option: str, score: str, chosen: str) -> DataFrame:
    """How many choosers' best option by score is the one that they chose."""
    best = scores.groupBy(chooser).agg(F.max_by(option, F.struct(score, F.xxhash64(option))).alias("best"), F.max(F.when(F.col(chosen), F.col(option))).alias("own"))
    return best.agg(F.sum((F.col("best") == F.col("own")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))


def sectors_of(settings: DataFrame) -> DataFrame:
    """sector, s, n, w, e of settings `sector<i> = s n w e`."""
    from lithos.functions.text import tokens

    p = tokens(F.col("value"))
    rows = settings.where(F.col("key").rlike(r"^sector\d+$"))
    return rows.select(F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("sector"), *(F.get(p, F.lit(i)).cast("double").alias(c) for i, c in enumerate("snwe")))


def sampled_ring_area(rings: DataFrame, n: int, seed: int) -> DataFrame:
    """name and the area of each ring by n seeded points in its box: a check of the shoelace formula."""
    lat, lon = (F.transform("ring", lambda v: v.getField("lat")), F.transform("ring", lambda v: v.getField("lon")))
    box = rings.select("name", "ring", F.array_min(lat).alias("s"), F.array_max(lat).alias("n"), F.array_min(lon).alias("w"), F.array_max(lon).alias("e"))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "name", "i"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = box.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    inside = geo.point_in_ring(F.col("s") + u(0) * (F.col("n") - F.col("s")), F.col("w") + u(1) * (F.col("e") - F.col("w")), F.col("ring"))
    return drawn.groupBy("name").agg((F.avg(inside.cast("double")) * F.first((F.col("n") - F.col("s")) * (F.col("e") - F.col("w")))).alias("area"))


def evolved(rows: DataFrame, names: list[str], target: str, population: int = 16, generations: int = 4, seed: int = 0):
    """The expression tree that predicts `target` best by squared error, and that error: seeded trees are crossed, perturbed
    and ranked; a generation's trees are scored together in one pass over the rows."""
    import random

    from lithos.functions import expression as E

    rng = random.Random(seed)
    trees = [E.random_tree(names, 4, rng) for _ in range(population)]

    def scored(ts):
        miss = [F.avg(F.least(F.pow(F.col(target) - E.column(t), F.lit(2.0)), F.lit(1e30))).alias(str(i)) for i, t in enumerate(ts)]
        row = rows.agg(*miss).first()
        return sorted(((row[i] if row[i] is not None else math.inf, i, t) for i, t in enumerate(ts)), key=lambda x: x[:2])

    ranked = scored(trees)
    for _ in range(generations):
        best = [t for _, _, t in ranked[: max(2, population // 4)]]
        children = [E.perturbed(E.crossover(rng.choice(best), rng.choice(best), rng), rng) for _ in range(population - len(best))]
        ranked = scored([*best, *children])
    return ranked[0][2], ranked[0][0]


#: Steps (lati, loni) of the eight directions.
STEPS = {"N": (1, 0), "NE": (1, 1), "E": (0, 1), "SE": (-1, 1), "S": (-1, 0), "SW": (-1, -1), "W": (0, -1), "NW": (1, -1)}


def stepped(cells: DataFrame, direction: Column) -> DataFrame:
    """Cells moved one step in the direction that a column names; unknown ones stay."""
    move = lambda k: F.coalesce(F.create_map(*(x for d, s in STEPS.items() for x in (F.lit(d), F.lit(s[k]))))[direction], F.lit(0))
    return cells.withColumns({"lati": F.col("lati") + move(0), "loni": F.col("loni") + move(1)})


def city(districts: DataFrame, box: tuple[float, float, float, float], centre: tuple[float, float]) -> DataFrame:
    """Districts (lat, lon) inside a box (south, north, west, east) with their distance to its centre in km."""
    inside = districts.where(geo.in_box(F.col("lat"), F.col("lon"), *box))
    return inside.withColumn("to_centre", geo.haversine(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])) / 1000)


def solved(systems: DataFrame, ident: str, a: str = "a", b: str = "b") -> DataFrame:
    """ident and x of the linear systems a x = b (array<array<double>>, array<double>), a few unknowns each, by elimination
    with pivoting; null where a is singular."""
    import numpy as np

    def solve(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for i, m, v in zip(pdf[ident], pdf[a], pdf[b]):
                try:
                    out.append((i, np.linalg.solve(np.stack([np.asarray(r, dtype=float) for r in m]), np.asarray(v, dtype=float)).tolist()))
                except np.linalg.LinAlgError:
                    out.append((i, None))
            yield pd.DataFrame(out, columns=[ident, "x"])

    rows = systems.select(ident, a, b)
    return rows.mapInPandas(solve, f"{ident} {dict(rows.dtypes)[ident]}, x array<double>")


def log_error(df: DataFrame, actual: str, predicted: str, by=None) -> DataFrame:
    """Root of the mean squared difference of logarithms."""
    return df.groupBy(*keys_of(by)).agg(F.sqrt(F.avg(F.pow(F.ln(predicted) - F.ln(actual), F.lit(2.0)))).alias("rms_log"))


def household_statistics(households: DataFrame, zone: str, value: str, people: str) -> DataFrame:
    """Total, mean per household and per person of a value, by zone."""
    return households.groupBy(zone).agg(F.sum(value).alias("total"), F.avg(value).alias("per_household"), F.try_divide(F.sum(value), F.sum(people)).alias("per_person"))
