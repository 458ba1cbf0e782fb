"""The region store: layers of regions, tables of values keyed by them, rasters and settings, found in a folder tree.

<root>/globals/* are settings; <root>/gis/*.gis rasters; <root>/gis/<layer>/membership.gis says which region each cell is
in, and the .tab and .csv files below <layer> are its tables, named by their path; a folder of that name with the part files
that Spark writes is one table, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators import grid as G
from lithos.sources import gis, text

RESERVED = {"membership", "centroid", "area"}


class Store:
    """A method for each request; each gives a DataFrame, or a value where one is asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.headers = gis.read_heads(spark, f"{self.root}/gis")
        self.tables = self._tables()

    def _tables(self) -> DataFrame:
        """layer, table, region, value_double, value_string of all table files, in one scan."""
        v = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.tab,*.csv,part-*}").text(f"{self.root}/gis")
        path = [F.regexp_extract("_metadata.file_path", r"/gis/([^/]+)/(.+)\.(?:tab|csv)(?:/part-[^/]*)?$", k) for k in (1, 2)]
        parts = F.split(F.trim("value"), r"\s*,\s*|\s+", 2)
        rows = v.where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).select(path[0].alias("layer"), path[1].alias("table"), F.get(parts, F.lit(0)).alias("region"), F.get(parts, F.lit(1)).alias("v"))
        bad = rows.where(F.element_at(F.split("table", "/"), -1).isin(*RESERVED)).select("table").first()
        if bad:
            raise ValueError(f"{bad.table} is a reserved name")
        quoted = F.col("v").startswith('"')
        return rows.select("layer", "table", "region", F.when(~quoted, text.number(F.col("v"))).alias("value_double"), F.when(quoted, F.regexp_extract("v", '"([^"]*)"', 1)).alias("value_string"))

    def layers(self) -> DataFrame:
        return self.headers.where(F.col("path").endswith("/membership.gis")).select(F.regexp_extract("path", r"/gis/([^/]+)/membership\.gis$", 1).alias("layer"), "categories")

    def rasters(self) -> DataFrame:
        return self.headers.where(~F.col("path").endswith("/membership.gis"))

    def regions(self, layer: str) -> DataFrame:
        """id, region of a layer; ids count from 0."""
        rows = self.layers().where(F.col("layer") == layer)
        return rows.select(F.posexplode("categories").alias("id", "region"))

    def table_names(self, layer: str) -> DataFrame:
        return self.tables.where(F.col("layer") == layer).select("table").distinct().orderBy("table")

    def values(self, layer: str, table: str) -> DataFrame:
        """Values of the layer's known regions; KeyError if there is no such table."""
        rows = self.tables.where((F.col("layer") == layer) & (F.col("table") == table))
        if rows.isEmpty():
            raise KeyError(f"{layer}/{table}")
        return rows.join(self.regions(layer), "region")

    def value(self, layer: str, table: str, region: str, default=None):
        row = self.values(layer, table).where(F.col("region") == region).first()
        if row is None:
            if default is None:
                raise KeyError(region)
            return default
        return row.value_string if row.value_string is not None else row.value_double

    def membership(self, layer: str) -> tuple[G.Grid, DataFrame]:
        head = self.headers.where(F.col("path").endswith(f"/gis/{layer}/membership.gis")).first()
        if head is None:
            raise KeyError(layer)
        grid = G.Grid(head.south, head.west, head.latsize, head.lonsize, head.latsteps, head.lonsteps)
        return grid, gis.read_cells(self.spark, head.path).select("lati", "loni", "value")

    def raster(self, name: str) -> tuple[G.Grid, DataFrame]:
        """Grid and cells of a raster of the store."""
        head = self.headers.where(F.col("path").endswith(f"/gis/{name}.gis")).first()
        if head is None:
            raise KeyError(name)
        return G.Grid(head.south, head.west, head.latsize, head.lonsize, head.latsteps, head.lonsteps), gis.read_cells(self.spark, head.path).select("lati", "loni", "value")

    def answers(self, requests: DataFrame) -> DataFrame:
        """`requests` (layer, table, region) with `answer`: the value as text, or a text that begins with ERROR and names what
        there isn't; all of them by one join."""
        known = self.layers().select("layer", F.explode("categories").alias("region"), F.lit(True).alias("known"))
        named = self.tables.select("layer", "table").distinct().withColumn("named", F.lit(True))
        value = self.tables.select("layer", "table", "region", F.coalesce("value_string", F.col("value_double").cast("string")).alias("value"))
        rows = requests.join(named, ["layer", "table"], "left").join(known, ["layer", "region"], "left").join(value, ["layer", "table", "region"], "left")
        missing = F.when(F.col("named").isNull(), F.concat_ws("/", "layer", "table")).otherwise(F.col("region"))
        answer = F.when(F.col("named").isNull() | F.col("known").isNull() | F.col("value").isNull(), F.concat(F.lit("ERROR no "), missing)).otherwise(F.col("value"))
        return rows.select(*requests.columns, answer.alias("answer"))

    def region_at(self, layer: str, points: DataFrame) -> DataFrame:
        """`points` (lat, lon) with the region that each lies in."""
        grid, cells = self.membership(layer)
        found = G.sample(points, cells, grid, "id_")
        return found.join(self.regions(layer).withColumnRenamed("id", "id_"), "id_", "left").drop("id_")

    def values_at(self, layer: str, table: str, points: DataFrame) -> DataFrame:
        found = self.region_at(layer, points)
        return found.join(self.values(layer, table).select("region", "value_double", "value_string"), "region", "left")

    def centroids(self, layer: str) -> DataFrame:
        grid, cells = self.membership(layer)
        return G.centroids(cells, grid)

    def areas(self, layer: str) -> DataFrame:
        grid, cells = self.membership(layer)
        return G.areas(cells, grid)

    def settings(self) -> DataFrame:
        return text.settings(self.spark, f"{self.root}/globals", r"\s*,\s*|\s+", unique=True)

    def setting(self, key: str, kind: str = "string", default=None):
        return text.setting(self.settings(), key, kind, default)

    def with_table(self, layer: str, table: str, rows: DataFrame) -> "Store":
        """A store whose table holds these rows (region, value_double, value_string) instead."""
        out = object.__new__(Store)
        out.__dict__ |= self.__dict__
        kept = self.tables.where(~((F.col("layer") == layer) & (F.col("table") == table)))
        out.tables = kept.unionByName(rows.select(F.lit(layer).alias("layer"), F.lit(table).alias("table"), "region", "value_double", "value_string"))
        return out

    def check(self) -> None:
        """Raises ValueError unless membership ids are whole and each names one of the layer's categories, and no table repeats a
        region. A region may have no cell of its own: it can be smaller than one, or covered by others."""
        from lithos.operators.joins import require_unique

        require_unique(self.tables, ["layer", "table", "region"])
        for row in self.layers().collect():
            _, cells = self.membership(row.layer)
            bad = cells.where("value IS NOT NULL").agg(F.bool_or((F.col("value") < 0) | (F.col("value") != F.floor("value"))), F.max("value")).first()
            if bad[0] or bad[1] is not None and bad[1] >= len(row.categories):
                raise ValueError(f"{row.layer}: cells of regions without a name")

    def dump(self) -> DataFrame:
        """All tables and settings as lines."""
        tables = self.tables.select(F.concat_ws(" ", "layer", "table", "region", F.coalesce("value_string", F.col("value_double").cast("string"))).alias("value"))
        return reduce(DataFrame.unionByName, [tables, self.settings().select(F.concat_ws(" ", F.lit("global"), "key", "value").alias("value"))])


#: Requests of one line, by verb: number of arguments and what answers them.
VERBS = {
    "getvalueforregion": (3, lambda s, *a: s.value(*a)),
    "listlayers": (0, lambda s: [r.layer for r in s.layers().orderBy("layer").collect()]),
    "listtables": (1, lambda s, layer: [r.table for r in s.table_names(layer).collect()]),
    "listregions": (1, lambda s, layer: [r.region for r in s.regions(layer).orderBy("id").collect()]),
    "getglobal": (1, lambda s, key: s.setting(key)),
}


def request(store: Store, line: str) -> str:
    """The answer to a line `verb argument ...`, or a line that begins with ERROR."""
    verb, *args = line.split()
    if verb.lower() not in VERBS:
        return f"ERROR unknown request {verb}"
    arity, answer = VERBS[verb.lower()]
    if len(args) != arity:
        return f"ERROR {verb} takes {arity} arguments"
    try:
        out = answer(store, *args)
    except KeyError as e:
        return f"ERROR no {e.args[0]}"
    return " ".join(map(str, out)) if isinstance(out, list) else str(out)
