"""The binary raster format: a text header, a magic number, and a gzipped or raw big-endian payload."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.grid import Grid

# Fixed values of the format.
MAGIC = 0x47495321
KINDS = {"BINARY": "?", "CATEGORICAL": ">i4", "CONTINUOUS": ">f4"}
HEADER = ("name", "projection", "minlat", "latsize", "minlong", "longsize", "minval", "maxval", "latsteps", "longsteps")
# end of fixed values

CELLS = "layer string, lati int, loni int, value double"


def encode(grid: Grid, values: np.ndarray, kind: str, name: str, categories: list[str] = ()) -> bytes:
    """A raster of doubles (rows from the south, nan for no data) as bytes; binary rows are packed to whole bytes."""
    ok = values[~np.isnan(values)]
    low, high = (float(ok.min()), float(ok.max())) if len(ok) else (0.0, 0.0)
    fields = dict(zip(HEADER, (name, "latlong", grid.south, grid.latsize, grid.west, grid.lonsize, low, high, grid.latsteps, grid.lonsteps)))
    head = "".join(f"{k} {v}\n" for k, v in fields.items()) + "".join(f"category {c}\n" for c in categories) + f"DATA {kind}\n"
    if kind == "BINARY":
        body = np.packbits(np.nan_to_num(values) > 0, axis=1).tobytes()
    elif kind == "CATEGORICAL":
        body = np.where(np.isnan(values), -1, values).astype(">i4").tobytes()
    else:
        body = values.astype(">f4").tobytes()
    return head.encode() + struct.pack(">i", MAGIC) + gzip.compress(body)


def decode(data: bytes) -> tuple[Grid, np.ndarray, str, str, list[str]]:
    """Grid, values, kind, name and categories; sizes may be given as maxlat and maxlong."""
    fields, categories, at = {}, [], 0
    while True:
        end = data.index(b"\n", at)
        key, _, value = data[at:end].decode().partition(" ")
        at = end + 1
        if key == "category":
            categories.append(value)
        else:
            fields[key] = value
        if key == "DATA":
            break
    if struct.unpack(">i", data[at : at + 4])[0] != MAGIC:
        raise ValueError("no raster: the magic number is missing")
    body = data[at + 4 :]
    body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
    south, west = float(fields["minlat"]), float(fields["minlong"])
    size = [float(fields[k]) if k in fields else float(fields[m]) - lo for k, m, lo in (("latsize", "maxlat", south), ("longsize", "maxlong", west))]
    ny, nx, kind = int(fields["latsteps"]), int(fields["longsteps"]), fields["DATA"]
    if kind == "BINARY":
        values = np.unpackbits(np.frombuffer(body, np.uint8).reshape(ny, -1), axis=1)[:, :nx].astype(float)
    else:
        values = np.frombuffer(body, KINDS[kind]).reshape(ny, nx).astype(float)
        if kind == "CATEGORICAL":
            values[values == -1] = np.nan
    return Grid(south, west, size[0], size[1], ny, nx), values, kind, fields.get("name", ""), categories


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """layer, lati, loni, value of every raster file under a path; a file is a task's work."""

    def cells(frames):
        import pandas as pd

        for pdf in frames:
            for data in pdf["content"]:
                grid, values, _, name, _ = decode(bytes(data))
                i, j = np.indices(values.shape)
                v = values.ravel()
                yield pd.DataFrame({"layer": name, "lati": i.ravel().astype("int32"), "loni": j.ravel().astype("int32"), "value": [None if np.isnan(x) else x for x in v]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gis").load(path).select("content").mapInPandas(cells, CELLS)


def raster_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, layer, kind and grid of every raster file."""

    def heads(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for where, data in zip(pdf["path"], pdf["content"]):
                g, _, kind, name, categories = decode(bytes(data))
                rows.append((where, name, kind, g.south, g.west, g.latsize, g.lonsize, g.latsteps, g.lonsteps, categories))
            yield pd.DataFrame(rows, columns=["path", "layer", "kind", "south", "west", "latsize", "lonsize", "latsteps", "lonsteps", "categories"])

    schema = "path string, layer string, kind string, south double, west double, latsize double, lonsize double, latsteps int, lonsteps int, categories array<string>"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gis").load(path).select("path", "content").mapInPandas(heads, schema)


def encoded(cells: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """layer and the file content (binary) of each layer of `cells`: one file is one group, by the nature of the format."""
    def one(pdf):
        import pandas as pd

        values = np.full((grid.latsteps, grid.lonsteps), np.nan)
        values[pdf["lati"].to_numpy(), pdf["loni"].to_numpy()] = pdf["value"].to_numpy(dtype=float)
        name = pdf["layer"].iloc[0]
        return pd.DataFrame({"layer": [name], "content": [encode(grid, values, kind, name)]})

    return cells.select("layer", "lati", "loni", F.col("value").cast("double").alias("value")).groupBy("layer").applyInPandas(one, "layer string, content binary")


def classified_pixels(pixels: DataFrame, rules: list[tuple]) -> DataFrame:
    """Pixels (lati, loni, r, g, b) with value: the category of the first rule (category, r0, r1, g0, g1, b0, b1) that holds
    them, -1 if none does."""
    value = F.lit(-1)
    for category, r0, r1, g0, g1, b0, b1 in reversed(rules):
        value = F.when(F.col("r").between(r0, r1) & F.col("g").between(g0, g1) & F.col("b").between(b0, b1), category).otherwise(value)
    return pixels.select("lati", "loni", value.alias("value"))


def any_rule(pixels: DataFrame, rules: list[tuple]) -> DataFrame:
    """Pixels (lati, loni, r, g, b) with value 1 where any rule (r0, r1, g0, g1, b0, b1) holds them, else 0."""
    found = classified_pixels(pixels, [(1, *r) for r in rules])
    return found.withColumn("value", F.greatest("value", F.lit(0)))


def pixel_places(pixels: DataFrame, south: float, west: float, north: float, east: float, width: int, height: int) -> DataFrame:
    """Pixels (x from the west, y from the north) of an image tile with the lat and lon of their centres."""
    lat = north - (F.col("y") + 0.5) * ((north - south) / height)
    return pixels.withColumns({"lat": lat, "lon": west + (F.col("x") + 0.5) * ((east - west) / width)})
