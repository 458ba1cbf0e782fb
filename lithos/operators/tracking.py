"""Positions from signals: probability grids as tables (sid, t, lati, loni, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import geo
from lithos.functions.maths import gaussian_log_pdf, path_loss
from lithos.operators.grid import PLACE, Grid
from lithos.operators.joins import part
from lithos.operators.stats import shares
from lithos.scratch import Scratch

KEY = ["sid", "t"]
#: Up to this many observers, what each cell expects of them rides with every task.
FEW_OBSERVERS = 256


def normalised(pmf: DataFrame) -> DataFrame:
    """Sums to 1 for each source and second; uniform where all is 0."""
    return shares(pmf, "p", KEY, "__q").withColumn("p", F.col("__q")).drop("__q")


def signal_grid(observations: DataFrame, observers: DataFrame, grid: Grid, at_one: float = -30.0, exponent: float = 2.0, sd: float = 6.0) -> DataFrame:
    """sid, t, lati, loni, p: for each source and second the product over its observations (rid, sid, t, dbm) of the normal
    density of what the path from each cell to the observer (rid, lat, lon, z) would leave, normalised.

    Up to FEW_OBSERVERS observers a source's second is one row with an array of its cells until it is done; with more of them, or
    if one stands twice, each cell is a row."""
    cells = grid.cells(observations.sparkSession).select(*PLACE, grid.lat(F.col("lati")).alias("clat"), grid.lon(F.col("loni")).alias("clon"))
    # the map of expected signals has one row for each observer and cell and doesn't grow with the observations
    flat = geo.haversine(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    maps = observers.join(F.broadcast(cells)).select("rid", *PLACE, path_loss(geo.distance_3d(flat, F.col("z")), at_one, exponent).alias("expected"))
    seen = observations.groupBy(*KEY, "rid").agg(F.avg("dbm").alias("dbm"), F.count(F.lit(1)).alias("n"))
    some, distinct = observers.agg(F.count("rid"), F.count_distinct("rid")).first()
    if some > FEW_OBSERVERS or some != distinct:
        logp = F.col("n") * gaussian_log_pdf(F.col("dbm"), F.col("expected"), sd)
        joint = seen.join(maps, "rid").groupBy(*KEY, *PLACE).agg(F.sum(logp).alias("logp"))
        top = joint.groupBy(*KEY).agg(F.max("logp").alias("top"))
        return normalised(joint.join(top, KEY).select(*KEY, *PLACE, F.exp(F.col("logp") - F.col("top")).alias("p")))
    known = maps.where(F.col("rid").isNotNull()).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(*PLACE, "expected"))).alias("cells"))
    every = known.agg(F.map_from_entries(F.collect_list(F.struct("rid", part("cells", "expected")))).alias("maps"))
    heard = seen.join(F.broadcast(observers.select("rid")), "rid", "left_semi")
    each = heard.groupBy(*KEY).agg(F.collect_list(F.struct("rid", "dbm", "n")).alias("heard"), F.count("dbm").alias("told"))
    add = lambda sums, o: F.zip_with(sums, F.element_at("maps", o["rid"]), lambda x, e: x + F.coalesce(o["n"] * gaussian_log_pdf(o["dbm"], e, sd), F.lit(0.0)))
    none = F.array_repeat(F.when(F.col("told") > 0, F.lit(0.0)), grid.latsteps * grid.lonsteps)
    # arrays of one element name what is used more than once, so that no cell computes it again
    logp = F.transform(F.array(F.aggregate("heard", none, add)), lambda x: F.struct(x.alias("v"), F.array_max(x).alias("top")))
    mass = F.transform(logp, lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    summed = F.transform(mass, lambda m: F.struct(m.alias("v"), F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("of")))
    share = F.transform(summed, lambda s: F.transform(s["v"], lambda x: x / s["of"]))
    rows = each.crossJoin(F.broadcast(every)).select(*KEY, F.posexplode(F.get(share, F.lit(0))).alias("k", "p"))
    k = F.col("k")
    return rows.select(*KEY, F.floor(k / grid.lonsteps).cast("int").alias("lati"), (k % grid.lonsteps).cast("int").alias("loni"), "p")


def seen_by(observations: DataFrame, around: int = 1) -> DataFrame:
    """sid, t and the sorted observers that heard the source within `around` seconds."""
    rows = observations.select("sid", "rid", F.explode(F.sequence(F.col("t") - around, F.col("t") + around)).alias("t")).distinct()
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_set("rid")).alias("seen"))


def with_detection(pmf: DataFrame, detect: DataFrame, seen: DataFrame, observers: DataFrame) -> DataFrame:
    """The grid times the chance (rid, lati, loni, d) that each observer hears, or doesn't hear, what it did."""
    pairs = pmf.join(F.broadcast(observers.select("rid"))).join(detect, ["rid", *PLACE]).join(seen, KEY, "left")
    heard = F.coalesce(F.array_contains("seen", F.col("rid")), F.lit(False))
    factor = F.ln(F.greatest(F.when(heard, F.col("d")).otherwise(1 - F.col("d")), F.lit(1e-12)))
    return normalised(pairs.groupBy(*KEY, *PLACE).agg((F.first("p") * F.exp(F.sum(factor))).alias("p")))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell product, normalised."""
    return normalised(a.join(b.withColumnRenamed("p", "__p"), [*KEY, *PLACE]).withColumn("p", F.col("p") * F.col("__p")).drop("__p"))


def added(a: DataFrame, b: DataFrame, weight_a: float = 1.0, weight_b: float = 1.0) -> DataFrame:
    both = a.withColumn("p", F.col("p") * weight_a).unionByName(b.withColumn("p", F.col("p") * weight_b))
    return both.groupBy(*KEY, *PLACE).agg(F.sum("p").alias("p"))


def complement(pmf: DataFrame) -> DataFrame:
    return pmf.withColumn("p", 1 - F.col("p"))


def projected(pmf: DataFrame, steps: int, speed: float, blocked: DataFrame | None = None) -> DataFrame:
    """The grid `steps` seconds on: each cell's mass spreads evenly over the cells within steps * speed (in cells); cells of
    `blocked` take none."""
    reach = steps * speed
    n = int(reach)
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= reach * reach))
    spread = pmf.withColumn("__m", F.explode(moves)).select("sid", (F.col("t") + steps).alias("t"), (F.col("lati") + F.col("__m.i")).alias("lati"), (F.col("loni") + F.col("__m.j")).alias("loni"), "p")
    if blocked is not None:
        spread = spread.join(F.broadcast(blocked.select(*PLACE)), PLACE, "left_anti")
    return normalised(spread.groupBy(*KEY, *PLACE).agg(F.sum("p").alias("p")))


def projected_around(pmf: DataFrame, reach: DataFrame, steps: int, speeds: list[float], size: float) -> DataFrame:
    """The grid `steps` seconds on, around obstacles: `reach` (lati, loni, to_lati, to_loni, dist) holds how long paths from cell
    to cell are, in cells of `size` metres, a cell's way to itself too. At each speed (m/s) a cell's mass spreads evenly over the
    cells within int(steps * speed / size), and the speeds weigh alike. Mass in cells without paths is lost before all is
    normalised. The spread is a table of its own, so that it is made once for all sources and seconds."""
    radii = F.array(*(F.lit(int(steps * v / size)) for v in speeds))
    ends = [*PLACE, "to_lati", "to_loni"]
    near = reach.select(*ends, "dist", F.posexplode(radii).alias("__speed", "__r")).where("dist <= __r").drop("dist", "__r")
    share = near.join(near.groupBy(*PLACE, "__speed").agg((1 / F.count(F.lit(1))).alias("__w")), [*PLACE, "__speed"])
    weights = share.groupBy(*ends).agg(F.sum("__w").alias("__w"))
    moved = pmf.join(weights, PLACE).groupBy("sid", (F.col("t") + steps).alias("t"), F.col("to_lati").alias("lati"), F.col("to_loni").alias("loni"))
    return normalised(moved.agg(F.sum(F.col("p") * F.col("__w")).alias("p")))


def sampled_cells(pmf: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """sid, t, draw, lati, loni: for each source and second `draws` cells, each drawn by the cells' mass; cells without mass are
    never drawn. Every cell races with an exponential clock as fast as its mass, and the first wins, so that a draw is an
    aggregate with partial minima, not a running sum over a whole grid. Clocks are md5 of seed, key, draw and cell; reruns agree."""
    name = F.concat_ws(":", F.lit(seed), "sid", "t", "draw", *PLACE)
    unit = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    runs = pmf.where("p > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    first = F.min(F.struct((-F.ln(unit) / F.col("p")).alias("clock"), *PLACE))
    return runs.groupBy(*KEY, "draw").agg(first.alias("c")).select(*KEY, "draw", "c.lati", "c.loni")


def uninformative(pmf: DataFrame) -> DataFrame:
    """sid, t of grids that are zero everywhere or uniform."""
    return pmf.groupBy(*KEY).agg(F.max("p").alias("hi"), F.min("p").alias("lo")).where("hi = 0 OR hi = lo").select(*KEY)


def occupancy(pmf: DataFrame, boxes: DataFrame, grid: Grid) -> DataFrame:
    """sector and the mean, over sources and seconds, of the mass in its box (sector, s, n, w, e)."""
    placed = pmf.withColumn("lat", grid.lat(F.col("lati"))).withColumn("lon", grid.lon(F.col("loni")))
    inside = placed.join(F.broadcast(boxes), geo.in_box(F.col("lat"), F.col("lon"), F.col("s"), F.col("n"), F.col("w"), F.col("e")))
    total = pmf.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("grids"))
    return inside.groupBy("sector").agg(F.sum("p").alias("mass")).crossJoin(F.broadcast(total)).select("sector", (F.col("mass") / F.col("grids")).alias("occupancy"))


def directions(pairs: DataFrame) -> DataFrame:
    """direction and its share, of position pairs (lat0, lon0, lat1, lon1)."""
    named = pairs.select(geo.bearing_class(*(F.col(c) for c in ("lat0", "lon0", "lat1", "lon1"))).alias("direction"))
    return shares(named.groupBy("direction").agg(F.count(F.lit(1)).alias("n")), "n", None, "share")


def mean_speed(pairs: DataFrame, by: str = "sid") -> DataFrame:
    """Mean speed (m/s) of each source's position pairs (lat0, lon0, t0, lat1, lon1, t1)."""
    d = geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return pairs.groupBy(by).agg(F.avg(F.try_divide(d, F.col("t1") - F.col("t0"))).alias("speed"))


def sight_map(blocked: DataFrame, observers: DataFrame, grid: Grid, per_cell: int = 4) -> DataFrame:
    """rid, lati, loni, sight: whether none of the points on the way from an observer to a cell's centre lies in a blocked
    cell. There are `per_cell` points for each cell of the way's length at least, both ends among them."""
    cells = grid.cells(blocked.sparkSession).select(*PLACE, grid.lat(F.col("lati")).alias("clat"), grid.lon(F.col("loni")).alias("clon"))
    ways = observers.join(F.broadcast(cells))
    length = F.hypot((F.col("clat") - F.col("lat")) / grid.dlat, (F.col("clon") - F.col("lon")) / grid.dlon)
    ways = ways.withColumn("__n", F.greatest(F.lit(1), F.ceil(length * per_cell))).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long"))))
    share = F.col("__s") / F.col("__n")
    at = ways.select("rid", *PLACE, grid.lati(F.col("lat") + (F.col("clat") - F.col("lat")) * share).alias("__i"), grid.loni(F.col("lon") + (F.col("clon") - F.col("lon")) * share).alias("__j"))
    walls = F.broadcast(blocked.select(F.col("lati").alias("__i"), F.col("loni").alias("__j"), F.lit(1).alias("__b")))
    return at.join(walls, ["__i", "__j"], "left").groupBy("rid", *PLACE).agg(F.max("__b").isNull().alias("sight"))


# Metres a second from which on a walker moves and above which nobody walks, and the shortest record in seconds.
STILL, FASTEST, SHORTEST = 0.5, 3.0, 40
# end of fixed values


def direction_weights(pmf: DataFrame, boxes: DataFrame, grid: Grid, size: float, draws: int = 20, least: int = 30, most: int = 120, seed: int = 0) -> DataFrame:
    """sector, direction (N, S, E, W, or - for who stands) and weight: which way walkers go in each box (sector, s, n, w, e).

    Sentinels are the grids of `pmf` (sid, t, lati, loni, p); sources with one of them or a record under 40 seconds are left out.
    Each pair of sentinels, by the rule of joins.gap_pairs(), is sampled `draws` times forward and as often backward: a place from
    each of both grids (cells of `size` metres), which says a speed and a way. Ways within 45 degrees of the row count as E
    whichever side they lead to, and all are turned round where time is. A draw that is too fast counts in the denominator only.
    Draws of a source weigh 1 together; each weighs in the sectors of both of its places, which are cells' southwest corners.
    """
    from lithos.operators.joins import gap_pairs, in_boxes

    scratch = Scratch(pmf.sparkSession, "directions")
    times = pmf.select("sid", F.col("t").cast("long").alias("t")).distinct()
    enough = times.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t") + 1).alias("long")).where((F.col("n") > 1) & (F.col("long") >= SHORTEST))
    pairs = scratch.save(gap_pairs(times.join(enough.select("sid"), "sid"), "sid", F.col("t"), least, most).withColumnRenamed("source", "sid"))
    paired = pairs.select("sid", F.col("t0").alias("t")).union(pairs.select("sid", "t1")).distinct()
    # a sentinel may end a pair and begin the next one, both ways round: four sets of draws
    cells = scratch.save(sampled_cells(pmf.withColumn("t", F.col("t").cast("long")).join(paired, ["sid", "t"]), 4 * draws, seed))
    each = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2 * draws))))
    place = lambda n, t, more: cells.select("sid", F.col("t").alias(t), (F.col("draw") - more).alias("k"), F.col("lati").alias(f"i{n}"), F.col("loni").alias(f"j{n}"))
    both = each.join(place(0, "t0", 0), ["sid", "t0", "k"]).join(place(1, "t1", 2 * draws), ["sid", "t1", "k"])
    back = F.col("k") > draws
    di, dj = F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0")
    di = F.when(back, -di).otherwise(di)
    speed = F.sqrt((di * di + dj * dj).cast("double")) * F.lit(float(size)) / (F.col("t1") - F.col("t0"))
    along = F.when(di * di < dj * dj, "E").when(di >= 0, "N").otherwise("S")
    turned = F.when(back, F.translate(along, "ENS", "WSN")).otherwise(along)
    told = both.select("sid", "i0", "j0", "i1", "j1", F.when(speed < STILL, "-").otherwise(turned).alias("direction"), (speed <= FASTEST).alias("walks"))
    totals = told.groupBy("sid").agg((1 / F.count(F.lit(1))).alias("weight"))
    counts = told.where("walks").withColumn("end", F.explode(F.array(F.struct(F.col("i0").alias("i"), F.col("j0").alias("j")), F.struct(F.col("i1").alias("i"), F.col("j1").alias("j")))))
    by_cell = counts.groupBy("sid", "direction", "end").agg(F.count(F.lit(1)).alias("n")).join(totals, "sid").groupBy("direction", "end").agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))
    placed = in_boxes(by_cell.select(F.concat_ws(":", "direction", "end.i", "end.j").alias("id"), "direction", "weight", (grid.south + F.col("end.i") * grid.dlat).alias("lat"), (grid.west + F.col("end.j") * grid.dlon).alias("lon")), boxes)
    return placed.where("sector >= 0").groupBy("sector", "direction").agg(F.sum("weight").alias("weight"))
