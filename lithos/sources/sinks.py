"""Text exports: cells, tables, KML, model logs, densities. Each is a DataFrame of lines until it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.grid import Grid


def cell_lines(cells: DataFrame, grid: Grid) -> DataFrame:
    """`lat lon value` at cell centres; cells without data are left out."""
    return cells.where("value IS NOT NULL").select(F.concat_ws(" ", grid.lat(F.col("lati")), grid.lon(F.col("loni")), "value").alias("value"))


def table_lines(df: DataFrame, columns: list[str], sep: str = " ", missing: str = "NA") -> DataFrame:
    """Columns as text, missing ones as `missing`."""
    return df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns)).alias("value"))


def ascii_grid_lines(cells: DataFrame, grid: Grid) -> DataFrame:
    """line, value of a text raster with its two header lines. A row of the raster is one group."""
    every = grid.cells(cells.sparkSession).join(cells, ["lati", "loni"], "left")
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loni", "value"))), lambda x: F.coalesce(x["value"].cast("string"), F.lit("NA"))), " ")
    rows = every.groupBy("lati").agg(row.alias("value")).select((F.col("lati") + 2).alias("line"), "value")
    box = (grid.south + grid.dlat / 2, grid.south + grid.latsize - grid.dlat / 2, grid.west + grid.dlon / 2, grid.west + grid.lonsize - grid.dlon / 2)
    head = cells.sparkSession.createDataFrame([(0, " ".join(map(repr, box))), (1, f"{grid.lonsteps} {grid.latsteps}")], "line int, value string")
    return head.unionByName(rows)


def placemarks(points: DataFrame, name: Column) -> DataFrame:
    """KML placemarks of points (lat, lon)."""
    text = F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit("</name><Point><coordinates>"), F.concat_ws(",", "lon", "lat", F.lit("0")), F.lit("</coordinates></Point></Placemark>"))
    return points.select(text.alias("value"))


def tracks(points: DataFrame, by: str, order: str) -> DataFrame:
    """A KML line for each track of points (lat, lon), in order. A track is one group."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "lat", "lon")))
    coords = F.array_join(F.transform(ordered, lambda p: F.concat_ws(",", p["lon"], p["lat"], F.lit("0"))), "\n")
    text = F.concat(F.lit("<Placemark><name>"), escaped(F.col(by).cast("string")), F.lit("</name><LineString><coordinates>\n"), F.col("c"), F.lit("\n</coordinates></LineString></Placemark>"))
    return points.groupBy(by).agg(coords.alias("c")).select(by, text.alias("value"))


def polygons(rings: DataFrame) -> DataFrame:
    """KML polygons of (name, ring)."""
    coords = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p["lon"], p["lat"], F.lit("0"))), "\n")
    text = F.concat(F.lit("<Placemark><name>"), escaped(F.col("name")), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>\n"), coords, F.lit("\n</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    return rings.select("name", text.alias("value"))


def escaped(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


HEADER = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
FOOTER = "</Document></kml>"


def kml(marks: DataFrame) -> str:
    """A whole document of a bounded number of placemarks, for a viewer."""
    return "\n".join([HEADER, *(r.value for r in marks.select("value").toLocalIterator()), FOOTER])


def model_lines(models: DataFrame) -> DataFrame:
    """Lines of a model log of (params, t, misfit)."""
    return models.select(F.concat(F.lit("PARAMETERS: "), F.array_join(F.col("params").cast("array<string>"), " "), F.lit(" TIME: "), F.col("t").cast("string"), F.lit(" MISFIT: "), F.col("misfit").cast("string")).alias("value"))


def density_lines(hist: DataFrame) -> DataFrame:
    """dim and the line of its counts. A dimension's bins are one small group."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "cnt"))), lambda x: x["cnt"].cast("string")), " ")
    return hist.groupBy("dim").agg(row.alias("value"))


def mapping_lines(mapping: DataFrame) -> DataFrame:
    """Lines `r1 , r2 : w , ...` of (r1, r2, w)."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r2", "w"))), lambda x: F.concat_ws(" : ", x["r2"], x["w"])), " , ")
    return mapping.groupBy("r1").agg(row.alias("m")).select("r1", F.concat_ws(" , ", "r1", "m").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def probability_lines(pmf: DataFrame, grid: Grid) -> DataFrame:
    """line, value of a probability grid's text, the northernmost row first. A row of the grid is one group."""
    every = grid.cells(pmf.sparkSession).join(pmf.select("lati", "loni", "p"), ["lati", "loni"], "left")
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loni", "p"))), lambda x: F.coalesce(x["p"], F.lit(0.0)).cast("string")), " ")
    return every.groupBy("lati").agg(row.alias("value")).select((grid.latsteps - 1 - F.col("lati")).alias("line"), "value")


def likely_track(pmf: DataFrame, grid: Grid) -> DataFrame:
    """A KML line through the best cell of each second, a source each."""
    from lithos.operators.grid import best_cell

    best = best_cell(pmf.withColumnRenamed("p", "value"), ["sid", "t"])
    return tracks(best.select("sid", "t", grid.lat(F.col("lati")).alias("lat"), grid.lon(F.col("loni")).alias("lon")), "sid", "t")


def quintile_report(df: DataFrame, rows: dict[str, str], weight: str) -> DataFrame:
    """row, mean and q1 to q5 for named columns: weighted means over all and by fifths of the weight."""
    from lithos.operators.stats import weighted_quintiles

    out = None
    for name, value in rows.items():
        q = weighted_quintiles(df, value, weight).groupBy().pivot("bucket", list(range(5))).agg(F.first("mean"))
        mean = df.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))
        one = mean.crossJoin(q).select(F.lit(name).alias("row"), "mean", *(F.col(str(i)).alias(f"q{i + 1}") for i in range(5)))
        out = one if out is None else out.unionByName(one)
    return out


class Outputs:
    """Named results; a name that is there already is an error unless it may be replaced."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def put(self, name: str, df: DataFrame, replace: bool = False) -> None:
        if name in self.tables and not replace:
            raise ValueError(f"output {name} is there already")
        self.tables[name] = df

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.parquet(f"{folder}/{name}")
