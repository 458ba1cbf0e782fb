"""Raster layers as long tables of cells (lati, loni, value) with a Grid that says where they lie. Null is no data.

lati counts from the south, loni from the west; a cell's centre is at (index + 0.5) steps; the outer edges belong to the
last cells. Categories are whole numbers from 0, binary layers hold 0 and 1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import geo

PLACE = ["lati", "loni"]


@dataclass(frozen=True)
class Grid:
    south: float
    west: float
    latsize: float
    lonsize: float
    latsteps: int
    lonsteps: int

    @property
    def dlat(self) -> float:
        return self.latsize / self.latsteps

    @property
    def dlon(self) -> float:
        return self.lonsize / self.lonsteps

    def lati(self, lat: Column) -> Column:
        return F.least(F.floor((lat - self.south) / self.latsize * self.latsteps), F.lit(self.latsteps - 1)).cast("int")

    def loni(self, lon: Column) -> Column:
        return F.least(F.floor((lon - self.west) / self.lonsize * self.lonsteps), F.lit(self.lonsteps - 1)).cast("int")

    def lat(self, lati: Column) -> Column:
        return self.south + (lati + 0.5) * self.dlat

    def lon(self, loni: Column) -> Column:
        return self.west + (loni + 0.5) * self.dlon

    def holds(self, lat: Column, lon: Column) -> Column:
        return geo.in_box(lat, lon, self.south, self.south + self.latsize, self.west, self.west + self.lonsize)

    def cells(self, spark) -> DataFrame:
        """All places of the grid."""
        n = spark.range(self.latsteps * self.lonsteps)
        return n.select(F.floor(F.col("id") / self.lonsteps).cast("int").alias("lati"), F.pmod("id", F.lit(self.lonsteps)).cast("int").alias("loni"))

    def coarser(self, k: int) -> "Grid":
        """The grid of k x k blocks; blocks that the edge cuts stay, and reach beyond it."""
        ny, nx = -(-self.latsteps // k), -(-self.lonsteps // k)
        return replace(self, latsize=ny * k * self.dlat, lonsize=nx * k * self.dlon, latsteps=ny, lonsteps=nx)

    @staticmethod
    def of_bounds(south: float, west: float, north: float, east: float, metres: float) -> "Grid":
        """Whole steps of about `metres`; the far bounds move so that the steps are whole."""
        import math

        dlat = geo.degrees_lat(metres)
        dlon = dlat / math.cos(math.radians((south + north) / 2))
        ny, nx = max(1, round((north - south) / dlat)), max(1, round((east - west) / dlon))
        return Grid(south, west, ny * dlat, nx * dlon, ny, nx)


def sample(points: DataFrame, cells: DataFrame, grid: Grid, out: str = "value") -> DataFrame:
    """`points` (lat, lon) with the value of the cell that each lies in; null outside."""
    inside = grid.holds(F.col("lat"), F.col("lon"))
    placed = points.withColumn("lati", F.when(inside, grid.lati(F.col("lat")))).withColumn("loni", F.when(inside, grid.loni(F.col("lon"))))
    return placed.join(cells.select(*PLACE, F.col("value").alias(out)), PLACE, "left").drop(*PLACE)


def sample_smooth(points: DataFrame, cells: DataFrame, grid: Grid, point_id: str = "id", out: str = "value") -> DataFrame:
    """point_id and the mean of the 3 x 3 cells around each point, weighted by 1 / distance of their centres in cells; the
    value of a centre nearer than 0.05."""
    y, x = (F.col("lat") - grid.south) / grid.dlat - 0.5, (F.col("lon") - grid.west) / grid.dlon - 0.5
    at = points.where(grid.holds(F.col("lat"), F.col("lon"))).select(point_id, y.alias("__y"), x.alias("__x"), grid.lati(F.col("lat")).alias("__i"), grid.loni(F.col("lon")).alias("__j"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    near = at.withColumn("__di", F.explode(steps)).withColumn("__dj", F.explode(steps))
    near = near.withColumn("lati", F.col("__i") + F.col("__di")).withColumn("loni", F.col("__j") + F.col("__dj")).join(cells.where("value IS NOT NULL"), PLACE)
    d = geo.planar(F.col("__y"), F.col("__x"), F.col("lati"), F.col("loni"))
    seen = near.withColumn("__d", d).withColumn("__w", 1 / F.greatest(F.col("__d"), F.lit(1e-9)))
    exact = F.min(F.when(F.col("__d") < 0.05, F.struct("__d", "value")))
    return seen.groupBy(point_id).agg(F.coalesce(exact["value"], F.sum(F.col("value") * F.col("__w")) / F.sum("__w")).alias(out))


def on_grid(cells: DataFrame, grid: Grid, other: DataFrame, other_grid: Grid, out: str = "other") -> DataFrame:
    """`cells` with the value that another layer has at each cell's centre."""
    centres = cells.withColumn("lat", grid.lat(F.col("lati"))).withColumn("lon", grid.lon(F.col("loni")))
    if grid == other_grid:
        return cells.join(other.select(*PLACE, F.col("value").alias(out)), PLACE, "left")
    inside = other_grid.holds(F.col("lat"), F.col("lon"))
    placed = centres.withColumn("__i", F.when(inside, other_grid.lati(F.col("lat")))).withColumn("__j", F.when(inside, other_grid.loni(F.col("lon"))))
    return placed.join(other.select(F.col("lati").alias("__i"), F.col("loni").alias("__j"), F.col("value").alias(out)), ["__i", "__j"], "left").drop("__i", "__j", "lat", "lon")


def zonal(regions: DataFrame, values: DataFrame) -> DataFrame:
    """region, mean, total and number of the values of each region's cells, both layers on one grid. Regions without values
    have none."""
    joined = regions.where("value IS NOT NULL").select(*PLACE, F.col("value").alias("region")).join(values, PLACE)
    return joined.groupBy("region").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n"))


def paint(regions: DataFrame, table: DataFrame, value: str, per_cell: bool = False) -> DataFrame:
    """The regions' layer with the value of each cell's region in `table` (region, value), over the region's number of cells
    if `per_cell`."""
    cells = regions.withColumnRenamed("value", "region")
    sizes = cells.groupBy("region").agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.join(table.select("region", F.col(value).cast("double").alias("__v")), "region", "left")
    v = F.col("__v") / F.col("__n") if per_cell else F.col("__v")
    return cells.join(small, "region", "left").select(*PLACE, v.alias("value"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, cells, total of a: cells of each region of one layer by region of another; null where there is none there."""
    left = a.where("value IS NOT NULL").select(*PLACE, F.col("value").alias("a"))
    counts = left.join(b.select(*PLACE, F.col("value").alias("b")), PLACE, "left").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cells"))
    return counts.join(counts.groupBy("a").agg(F.sum("cells").alias("total")), "a")


def union_binary(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 where either of two layers on one grid is above 0."""
    both = a.select(*PLACE, "value").unionByName(b.select(*PLACE, "value"))
    return both.groupBy(*PLACE).agg(F.max((F.coalesce("value", F.lit(0)) > 0).cast("double")).alias("value"))


def masked(cells: DataFrame, mask: DataFrame, inside: bool, fill=None) -> DataFrame:
    """The layer with `fill` in (inside) or outside the cells where the mask is above 0; the mask's value where fill is "mask"."""
    joined = cells.join(mask.select(*PLACE, F.col("value").alias("__m")), PLACE, "left")
    on = F.coalesce(F.col("__m") > 0, F.lit(False))
    new = F.col("__m") if fill == "mask" else F.lit(fill).cast("double")
    return joined.withColumn("value", F.when(on if inside else ~on, new).otherwise(F.col("value"))).select(*PLACE, "value")


def cropped(cells: DataFrame, by: DataFrame) -> DataFrame:
    """Cells where another layer on the grid has data."""
    return cells.join(by.where("value IS NOT NULL").select(*PLACE), PLACE, "left_semi")


def replace_missing(cells: DataFrame, v: float) -> DataFrame:
    return cells.withColumn("value", F.coalesce("value", F.lit(v)))


def remapped(cells: DataFrame, table: DataFrame) -> DataFrame:
    """Rounded values replaced by a table's (from, to); others become null."""
    keyed = cells.withColumn("from", F.floor(F.col("value") + 0.5).cast("long"))
    return keyed.join(table.select(F.col("from").cast("long").alias("from"), "to"), "from", "left").select(*PLACE, F.col("to").alias("value"))


def log_scaled(cells: DataFrame, pivot: float | None = None) -> DataFrame:
    """log(value + pivot); by default the least value if it is 1 or more, else 1 - it."""
    if pivot is not None:
        return cells.withColumn("value", F.ln(F.col("value") + pivot))
    low = cells.agg(F.min("value").alias("__lo"))
    by = F.when(F.col("__lo") >= 1, F.col("__lo")).otherwise(1 - F.col("__lo"))
    return cells.crossJoin(F.broadcast(low)).withColumn("value", F.ln(F.col("value") + by)).drop("__lo")


def sqrt_scaled(cells: DataFrame) -> DataFrame:
    low = cells.agg(F.min("value").alias("__lo"))
    return cells.crossJoin(F.broadcast(low)).withColumn("value", F.sqrt(F.col("value") - F.col("__lo"))).drop("__lo")


def set_values(cells: DataFrame, new: DataFrame) -> DataFrame:
    """The layer with the cells of `new` in place of its own."""
    return cells.join(new.select(*PLACE), PLACE, "left_anti").unionByName(new.select(*PLACE, "value"))


def shrunk(cells: DataFrame, k: int, rule: str) -> DataFrame:
    """Blocks of k x k cells by `rule`: binary (at least half of k^2, rounded up, are 1), mode (the commonest, the smallest of
    several, no data a class of its own), known_mode (no data left out), mean, sum."""
    block = [F.floor(F.col(c) / k).cast("int").alias(c) for c in PLACE]
    if rule in ("mode", "known_mode"):
        rows = cells if rule == "mode" else cells.where("value IS NOT NULL")
        counts = rows.groupBy(*block, "value").agg(F.count(F.lit(1)).alias("n"))
        order = F.struct(F.col("n"), -F.coalesce("value", F.lit(-1.0)), F.col("value"))
        return counts.groupBy(*PLACE).agg(F.max(order).alias("m")).select(*PLACE, F.col("m.value").alias("value"))
    agg = {"binary": (F.sum((F.col("value") > 0).cast("int")) >= int(k * k / 2 + 0.5)).cast("double"), "mean": F.avg("value"), "sum": F.sum("value")}[rule]
    return cells.groupBy(*block).agg(agg.alias("value"))


def offsets(grid: Grid, metres: float) -> list[tuple[int, int, float]]:
    """(di, dj, metres) of cells whose centre is at most so far from another's, by distances at the grid's south-west."""
    import math

    south = math.radians(grid.south)
    dy, dx = math.radians(grid.dlat) * geo.EARTH_M, math.radians(grid.dlon) * geo.EARTH_M * math.cos(south)
    ny, nx = int(metres / dy), int(metres / dx)
    return [(i, j, math.hypot(i * dy, j * dx)) for i in range(-ny, ny + 1) for j in range(-nx, nx + 1) if math.hypot(i * dy, j * dx) <= metres]


def focal(cells: DataFrame, steps: list[tuple], agg: Column, at: DataFrame | None = None) -> DataFrame:
    """`agg` over value, weight of the cells at `steps` (di, dj, weight) from each place (of `cells`, or of `at`)."""
    spark = cells.sparkSession
    moves = F.broadcast(spark.createDataFrame([tuple(map(float, s)) for s in steps], "di double, dj double, weight double"))
    # each cell with data is sent to the places that it counts for
    sent = cells.where("value IS NOT NULL").crossJoin(moves).select((F.col("lati") - F.col("di")).cast("int").alias("lati"), (F.col("loni") - F.col("dj")).cast("int").alias("loni"), "value", "weight")
    places = (at or cells).select(*PLACE)
    return places.join(sent.groupBy(*PLACE).agg(agg.alias("value")), PLACE, "left")


def radius_sum(cells: DataFrame, grid: Grid, centres: DataFrame, metres: float) -> DataFrame:
    """`centres` (lat, lon, other columns) with `total`: the sum of the cells within the radius of the centre's cell."""
    at = centres.withColumn("lati", grid.lati(F.col("lat"))).withColumn("loni", grid.loni(F.col("lon")))
    sums = focal(cells, offsets(grid, metres), F.sum("value"), at.select(*PLACE).distinct())
    return at.join(sums.withColumnRenamed("value", "total"), PLACE, "left").withColumn("total", F.coalesce("total", F.lit(0.0))).drop(*PLACE)


def decay_sum(cells: DataFrame, grid: Grid, metres: float, least: float) -> DataFrame:
    """Sum of value / km^2 of the cells within the radius, none taken as nearer than `least` metres."""
    steps = [(i, j, 1 / (max(d, least) / 1000) ** 2) for i, j, d in offsets(grid, metres)]
    return focal(cells, steps, F.sum(F.col("value") * F.col("weight")))


def covered_area(cells: DataFrame, grid: Grid, metres: float) -> DataFrame:
    """Square kilometres of cells above 0 within the radius."""
    import math

    size = math.radians(grid.dlat) * geo.EARTH_M / 1000 * math.radians(grid.dlon) * geo.EARTH_M / 1000 * math.cos(math.radians(grid.south + grid.latsize / 2))
    return focal(cells.where("value > 0"), offsets(grid, metres), F.count(F.lit(1)) * size, cells)


def dilated(cells: DataFrame) -> DataFrame:
    """1 where the cell or one of its eight neighbours is above 0."""
    steps = [(i, j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return focal(cells, steps, F.max((F.col("value") > 0).cast("double")))


FOUR = [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)]


def neighbours(cells: DataFrame) -> DataFrame:
    """Cells with `other`, the value of each of their four neighbours that the layer holds."""
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in FOUR))
    near = cells.withColumn("__m", F.explode(moves)).withColumn("__i", F.col("lati") + F.col("__m.i")).withColumn("__j", F.col("loni") + F.col("__m.j"))
    return near.join(cells.select(F.col("lati").alias("__i"), F.col("loni").alias("__j"), F.col("value").alias("other")), ["__i", "__j"]).drop("__i", "__j", "__m")


def boundary(cells: DataFrame) -> DataFrame:
    """1 where a neighbour's value differs, else 0."""
    differs = neighbours(cells).groupBy(*PLACE).agg(F.max((~F.col("value").eqNullSafe(F.col("other"))).cast("double")).alias("edge"))
    return cells.select(*PLACE).join(differs, PLACE, "left").select(*PLACE, F.coalesce("edge", F.lit(0.0)).alias("value"))


def adjacency(regions: DataFrame) -> DataFrame:
    """a, b and the number of sides that their cells share, in both directions."""
    pairs = neighbours(regions.where("value IS NOT NULL")).where("value <> other")
    return pairs.groupBy(F.col("value").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("sides"))


def centroids(regions: DataFrame, grid: Grid) -> DataFrame:
    """The place of the mean cell of each region; indices are averaged, which is exact, and scaled once."""
    return regions.where("value IS NOT NULL").groupBy(F.col("value").alias("region")).agg(grid.lat(F.avg("lati")).alias("lat"), grid.lon(F.avg("loni")).alias("lon"))


def areas(regions: DataFrame, grid: Grid) -> DataFrame:
    """Cells and square kilometres of each region, by the size of the grid's middle cell."""
    import math

    size = math.radians(grid.dlat) * geo.EARTH_M / 1000 * math.radians(grid.dlon) * geo.EARTH_M / 1000 * math.cos(math.radians(grid.south + grid.latsize / 2))
    return regions.where("value IS NOT NULL").groupBy(F.col("value").alias("region")).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * size).alias("km2"))


def distinct_values(cells: DataFrame) -> DataFrame:
    return cells.where("value >= 0").select("value").distinct().orderBy("value")


def quadtree(cells: DataFrame, depth: int) -> DataFrame:
    """Blocks (depth, lati, loni, value) of a complete 2^depth grid that hold one value and whose parents don't."""
    blocks, out = cells.select(*PLACE, "value"), None
    for d in range(depth, 0, -1):
        up = blocks.groupBy(*(F.floor(F.col(c) / 2).cast("int").alias(c) for c in PLACE)).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        merged = up.where("n = 4 AND lo = hi")
        parents = merged.select(F.col("lati").alias("__i"), F.col("loni").alias("__j"))
        left = blocks.withColumn("__i", F.floor(F.col("lati") / 2).cast("int")).withColumn("__j", F.floor(F.col("loni") / 2).cast("int")).join(parents, ["__i", "__j"], "left_anti")
        leaves = left.select(F.lit(d).alias("depth"), *PLACE, "value")
        out = leaves if out is None else out.unionByName(leaves)
        blocks = merged.select(*PLACE, F.col("lo").alias("value"))
    return out.unionByName(blocks.select(F.lit(0).alias("depth"), *PLACE, "value"))


def nearest_match(cells: DataFrame, places: DataFrame, wanted: str, most: int = 10) -> DataFrame:
    """`places` (lati, loni, a wanted value) with `radius`: the least of up to `most` steps along one of the eight directions
    that leads to a cell of that value (0 at the place itself); null if there is none."""
    way = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    steps = sorted({(i * r, j * r, r) for r in range(most + 1) for i, j in way if (i, j) != (0, 0) or r == 0})
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(r).alias("r")) for i, j, r in steps))
    near = places.withColumn("__m", F.explode(moves)).withColumn("__i", F.col("lati") + F.col("__m.i")).withColumn("__j", F.col("loni") + F.col("__m.j"))
    hit = near.join(cells.select(F.col("lati").alias("__i"), F.col("loni").alias("__j"), F.col("value").alias(wanted)), ["__i", "__j", wanted])
    best = hit.groupBy(*PLACE, wanted).agg(F.min("__m.r").alias("radius"))
    return places.join(best, [*PLACE, wanted], "left")


def best_cell(cells: DataFrame, by=None) -> DataFrame:
    """The cell with the largest value, the southernmost and westernmost of several."""
    keys = [by] if isinstance(by, str) else list(by or [])
    top = cells.groupBy(*keys).agg(F.max(F.struct("value", -F.col("lati"), -F.col("loni"), "lati", "loni")).alias("__top"))
    return top.select(*keys, "__top.lati", "__top.loni", "__top.value")


def rasterised(points: DataFrame, grid: Grid, value: str | None = None) -> DataFrame:
    """Number of points (lat, lon), or mean of a value, in each cell that has any."""
    inside = points.where(grid.holds(F.col("lat"), F.col("lon")))
    agg = F.count(F.lit(1)).cast("double") if value is None else F.avg(value)
    return inside.groupBy(grid.lati(F.col("lat")).alias("lati"), grid.loni(F.col("lon")).alias("loni")).agg(agg.alias("value"))


def near_sites(grid: Grid, sites: DataFrame, metres: float) -> DataFrame:
    """All cells of a grid with 1 where a site (lat, lon) is within the radius of the centre, else 0."""
    from lithos.operators.joins import within

    cells = grid.cells(sites.sparkSession).withColumn("lat", grid.lat(F.col("lati"))).withColumn("lon", grid.lon(F.col("loni")))
    hit = within(cells, sites.select("lat", "lon"), metres).select(*PLACE).distinct().withColumn("__hit", F.lit(1.0))
    return cells.select(*PLACE).join(hit, PLACE, "left").select(*PLACE, F.coalesce("__hit", F.lit(0.0)).alias("value"))


def unique_per_place(cells: DataFrame) -> DataFrame:
    """One cell a place, the largest value of several."""
    return cells.groupBy(*PLACE).agg(F.max("value").alias("value"))


def row_order() -> Window:
    return Window.partitionBy("lati").orderBy("loni")
