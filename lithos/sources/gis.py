"""The binary raster format as a Spark data source: `spark.read.format("gis")` and `df.write.format("gis")`.

A file is read by many tasks, a band of rows each, and only the bands and columns that filters on lati and loni leave. Raw
payloads are cut by arithmetic. Compressed ones that this package writes are a chain of gzip members, one a band, each with
its own length in its header, so that a reader hops from one to the next and any other program reads them as one stream; a
payload of one member, as others write it, is one task's work, in blocks of bounded size.

Cells are encoded by band, in tasks; the writer takes a layer's encoded bands in order and puts them behind each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from lithos.operators.grid import Grid
from lithos.scratch import Scratch
from lithos.session import ship
from lithos.sources.raster import CELLS, HEADER, KINDS, MAGIC

HEADS = "path string, layer string, kind string, south double, west double, latsize double, lonsize double, latsteps int, lonsteps int, categories array<string>"
BANDS = "layer string, band int, content binary"
#: Cells of a band, and bytes that a header may take and that are read at once.
BAND_CELLS, HEAD_BYTES, BLOCK = 1 << 20, 1 << 16, 1 << 22
#: Identifier of the subfield of a gzip member's header that holds the member's length.
LENGTH_FIELD = b"LB"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """All raster files under a path, or the file itself; names begin with the path's scheme."""
    where, inner = opened(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and (x.path.endswith(".gis") or len(found) == 1))


@dataclass
class Head:
    """What a file says before its cells. `at` is where these begin, `size` the length of the file."""

    path: str
    fields: dict
    categories: list
    at: int
    size: int

    @property
    def kind(self) -> str:
        return self.fields["DATA"]

    @property
    def grid(self) -> Grid:
        """Sizes may be given as maxlat and maxlong."""
        south, west = float(self.fields["minlat"]), float(self.fields["minlong"])
        size = [float(self.fields[k]) if k in self.fields else float(self.fields[m]) - lo for k, m, lo in (("latsize", "maxlat", south), ("longsize", "maxlong", west))]
        return Grid(south, west, *size, int(self.fields["latsteps"]), int(self.fields["longsteps"]))

    @property
    def row_bytes(self) -> int:
        n = int(self.fields["longsteps"])
        return (n + 7) // 8 if self.kind == "BINARY" else 4 * n


def head_of(path: str) -> Head:
    where, inner = opened(path)
    with where.open_input_file(inner) as f:
        size, data, fields, categories, at = f.size(), f.read(HEAD_BYTES), {}, [], 0
        while "DATA" not in fields:
            end = data.find(b"\n", at)
            if end < 0:
                more = f.read(HEAD_BYTES)
                if not more:
                    raise ValueError(f"{path}: no raster, its header doesn't end")
                data += more
                continue
            key, _, value = data[at:end].decode().partition(" ")
            at = end + 1
            if key == "category":
                categories.append(value)
            else:
                fields[key] = value
        f.seek(at)
        if f.read(4) != struct.pack(">i", MAGIC):
            raise ValueError(f"{path}: no raster, the magic number is missing")
    if fields["DATA"] not in KINDS:
        raise ValueError(f"{path}: unknown kind {fields['DATA']}")
    return Head(path, fields, categories, at + 4, size)


@dataclass
class Band(InputPartition):
    """Rows `first` to `last` (not included) of a file, which lie in its bytes from `at` on: `size` bytes of one gzip member, or
    of raw cells; with `whole`, in a stream of members that begins at `at` with row 0."""

    head: Head
    first: int
    last: int
    at: int
    size: int
    packed: bool
    whole: bool = False

    def __init__(self, head, first, last, at, size, packed, whole=False):
        super().__init__(None)
        self.head, self.first, self.last, self.at, self.size, self.packed, self.whole = head, first, last, at, size, packed, whole


def member(data: bytes) -> bytes:
    """A gzip member whose header says how long it is."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = LENGTH_FIELD + struct.pack("<HI", 4, 10 + 2 + 8 + len(body) + 8)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_sizes(f, at: int, size: int) -> list[tuple[int, int]] | None:
    """Place and length of the members from `at` to the end of a file; None unless each says its length."""
    out = []
    while at < size:
        f.seek(at)
        start = f.read(20)
        if len(start) < 20 or start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != LENGTH_FIELD:
            return None
        (n,) = struct.unpack("<I", start[16:20])
        out.append((at, n))
        at += n
    return out if at == size else None


def bands(head: Head) -> list[Band]:
    """The parts of a file that different tasks can read."""
    rows, width = head.grid.latsteps, head.row_bytes
    where, inner = opened(head.path)
    with where.open_input_file(inner) as f:
        f.seek(head.at)
        packed = f.read(2) == b"\x1f\x8b"
        members = member_sizes(f, head.at, head.size) if packed else None
        if members is not None:
            out, row = [], 0
            for at, n in members:
                f.seek(at + n - 4)
                (cells,) = struct.unpack("<I", f.read(4))
                out.append(Band(head, row, row + cells // max(1, width), at, n, True))
                row += cells // max(1, width)
            return out
    if packed:
        return [Band(head, 0, rows, head.at, head.size - head.at, True, True)]
    step = max(1, BAND_CELLS // max(1, head.grid.lonsteps))
    return [Band(head, a, min(a + step, rows), head.at + a * width, (min(a + step, rows) - a) * width, False) for a in range(0, rows, step)]


def raw(band: Band) -> Iterator[bytes]:
    """The band's bytes, decompressed, in blocks of bounded size."""
    where, inner = opened(band.head.path)
    with where.open_input_file(inner) as f:
        f.seek(band.at)
        left, stream = band.size, zlib.decompressobj(31)
        while left > 0 and (data := f.read(min(BLOCK, left))):
            left -= len(data)
            if not band.packed:
                yield data
            while band.packed and data:
                yield stream.decompress(data, BLOCK)
                data = stream.unconsumed_tail
                if stream.eof:
                    data, stream = stream.unused_data, zlib.decompressobj(31)


def values_of(kind: str, data: bytes, columns: int) -> np.ndarray:
    """Values of whole rows, as doubles; nan where there are none."""
    if kind == "BINARY":
        return np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, (columns + 7) // 8), axis=1)[:, :columns].astype(float)
    values = np.frombuffer(data, KINDS[kind]).reshape(-1, columns).astype(float)
    if kind == "CATEGORICAL":
        values[values == -1] = np.nan
    return values


class CellReader(DataSourceReader):
    """Cells of raster files. Bounds on lati and loni are pushed down: bands without such rows aren't read."""

    def __init__(self, path: str):
        self.path, self.low, self.high = path, {"lati": 0, "loni": 0}, {"lati": 1 << 40, "loni": 1 << 40}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in self.low or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                yield f
            elif not isinstance(f, IsNotNull):  # places are never null
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value + (not isinstance(f, LessThan)))

    def partitions(self):
        every = [b for path in files(self.path) for b in bands(head_of(path))]
        return [b for b in every if b.first < self.high["lati"] and b.last > self.low["lati"]] or [InputPartition(None)]

    def read(self, band):
        if not isinstance(band, Band):
            return
        grid, width, name, rest, row = band.head.grid, band.head.row_bytes, band.head.fields.get("name", ""), b"", band.first
        left, right = max(0, self.low["loni"]), min(grid.lonsteps, self.high["loni"])
        for data in raw(band) if width and left < right else ():
            rest += data
            n = len(rest) // width
            values, rest = values_of(band.head.kind, rest[: n * width], grid.lonsteps), rest[n * width :]
            a, b = max(0, self.low["lati"] - row), min(n, self.high["lati"] - row)
            if a < b:
                part = values[a:b, left:right]
                i, j = (np.broadcast_to(x, part.shape).ravel().astype(np.int32) for x in (np.arange(row + a, row + b)[:, None], np.arange(left, right)[None, :]))
                v = part.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(i), pa.array(j), pa.array(v, pa.float64(), mask=np.isnan(v))], names=["layer", "lati", "loni", "value"])
            row += n


class HeadReader(DataSourceReader):
    """A row for each raster file, of which the header alone is read."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in files(self.path)] or [InputPartition(None)]

    def read(self, part):
        if part.value is not None:
            h = head_of(part.value)
            g = h.grid
            yield (h.path, h.fields.get("name", ""), h.kind, g.south, g.west, g.latsize, g.lonsize, g.latsteps, g.lonsteps, h.categories)


@dataclass
class Written(WriterCommitMessage):
    paths: list


class BandWriter(DataSourceArrowWriter):
    """Files of encoded bands (layer, band, content) that come by layer in order of their bands. A file has another name until
    all tasks are done, so that a task that runs again leaves no half of one."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        where, folder = opened(self.folder)
        where.create_dir(folder, recursive=True)
        done, layer, out = [], None, None
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in iterator:
            for name, content in zip(batch.column("layer").to_pylist(), batch.column("content")):
                if name != layer:
                    if out is not None:
                        out.close()
                    layer = name
                    done.append((f"{folder}/_{name}.{attempt}", f"{folder}/{name}.gis"))
                    out = where.open_output_stream(done[-1][0])
                out.write(content.as_buffer())
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages):
        where, _ = opened(self.folder)
        for m in messages:
            for old, new in m.paths if m else ():
                where.move(old, new)

    def abort(self, messages):
        where, _ = opened(self.folder)
        for m in messages:
            for old, _ in m.paths if m else ():
                where.delete_file(old)


class Gis(DataSource):
    """Raster files. Option `what`: cells (the default) or heads."""

    @classmethod
    def name(cls):
        return "gis"

    def schema(self):
        return HEADS if self.options.get("what") == "heads" else CELLS

    def reader(self, schema):
        return (HeadReader if self.options.get("what") == "heads" else CellReader)(self.options["path"])

    def writer(self, schema, overwrite):
        return BandWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    ship(spark)
    spark.dataSource.register(Gis)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """layer, lati, loni, value of every raster file under a path."""
    register(spark)
    return spark.read.format("gis").load(path)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """path, layer, kind, grid and categories of every raster file under a path."""
    register(spark)
    return spark.read.format("gis").option("what", "heads").load(path)


def encoded_bands(cells: DataFrame, grid: Grid, kind: str, categories: DataFrame | None = None, band_cells: int = BAND_CELLS) -> DataFrame:
    """layer, band, content: the encoded bands of every layer of `cells` (layer, lati, loni, value), and as band -1 its header.
    Bands without cells are written, too. `categories` (layer, id, category) names the values of categorical layers from 0 on."""
    spark = cells.sparkSession
    step = max(1, band_cells // max(1, grid.lonsteps))
    n = -(-grid.latsteps // step)
    rows = cells.where((F.col("lati") >= 0) & (F.col("lati") < grid.latsteps) & (F.col("loni") >= 0) & (F.col("loni") < grid.lonsteps)).select("layer", F.floor(F.col("lati") / step).cast("int").alias("band"), "lati", "loni", F.col("value").cast("double").alias("value"))
    layers = rows.groupBy("layer").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    empty = layers.select("layer", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"), F.lit(None).cast("int").alias("lati"), F.lit(None).cast("int").alias("loni"), F.lit(None).cast("double").alias("value"))

    def encode(key, table):
        first = key[1].as_py() * step
        values = np.full((min(step, grid.latsteps - first), grid.lonsteps), np.nan)
        i, j, v = (table.column(c).to_numpy() for c in ("lati", "loni", "value"))
        ok = ~np.isnan(i.astype(float))
        values[i[ok].astype(int) - first, j[ok].astype(int)] = v[ok].astype(float)
        if kind == "BINARY":
            body = np.packbits(np.nan_to_num(values) > 0, axis=1).tobytes()
        else:
            body = (np.where(np.isnan(values), -1, values) if kind == "CATEGORICAL" else values).astype(KINDS[kind]).tobytes()
        return pa.table({"layer": [key[0].as_py()], "band": pa.array([key[1].as_py()], pa.int32()), "content": [member(body)]})

    named = layers.withColumn("lines", F.lit(""))
    if categories is not None:
        lines = categories.groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "category"))), lambda c: F.concat(F.lit("category "), c["category"], F.lit("\n"))), "").alias("lines"))
        named = layers.join(lines, "layer", "left").withColumn("lines", F.coalesce("lines", F.lit("")))
    said = {"name": F.col("layer"), "projection": F.lit("latlong"), "minlat": F.lit(grid.south), "latsize": F.lit(grid.latsize), "minlong": F.lit(grid.west), "longsize": F.lit(grid.lonsize), "minval": F.coalesce("low", F.lit(0.0)), "maxval": F.coalesce("high", F.lit(0.0)), "latsteps": F.lit(grid.latsteps), "longsteps": F.lit(grid.lonsteps)}
    text = F.concat(*(F.concat(F.lit(f"{k} "), said[k].cast("string"), F.lit("\n")) for k in HEADER), F.col("lines"), F.lit(f"DATA {kind}\n"))
    heads = named.select("layer", F.lit(-1).alias("band"), F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(struct.pack(">i", MAGIC).hex()))).alias("content"))
    ship(spark)
    return heads.unionByName(rows.unionByName(empty).groupBy("layer", "band").applyInArrow(encode, BANDS))


def write_cells(cells: DataFrame, grid: Grid, kind: str, path: str, categories: DataFrame | None = None, band_cells: int = BAND_CELLS) -> None:
    """A file <layer>.gis in the folder `path` for each layer of `cells`. Bands are encoded by many tasks; one file is put
    together by one, which only copies bytes."""
    register(cells.sparkSession)
    done = Scratch(cells.sparkSession, "gis").save(encoded_bands(cells, grid, kind, categories, band_cells))
    done.repartition("layer").sortWithinPartitions("layer", "band").write.format("gis").mode("append").save(path)
