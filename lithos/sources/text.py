"""Readers of text formats into DataFrames. Missing values ("NA", nan, blank) become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.text import day_month_year, tokens
from lithos.operators.joins import require_all, require_unique


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value: lines without comments (#) and blank ones."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), value of whole small files: a file is one row first."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def number(x: Column) -> Column:
    """Double of a text; null for NA, nan and what is none."""
    return F.nullif(F.when(F.lower(x).isin("na", "nan"), F.lit(None)).otherwise(x).try_cast("double"), F.lit(float("nan")))


def vectors(spark: SparkSession, path: str, ragged: bool = False, delimiter: str = " ") -> DataFrame:
    """values: array<double> of each line. Raises ValueError for an empty file, and for rows of different widths unless
    `ragged`. Two delimiters in a row make an empty, null value."""
    rows = lines(spark, path).select(F.transform(F.split(F.trim("value"), delimiter), number).alias("values"))
    widths = [r.w for r in rows.select(F.size("values").alias("w")).distinct().limit(2).collect()]
    if not widths:
        raise ValueError(f"{path} is empty")
    if len(widths) > 1 and not ragged:
        raise ValueError(f"{path} has rows of different widths")
    return rows


def int_vectors(spark: SparkSession, path: str, ragged: bool = False) -> DataFrame:
    return vectors(spark, path, ragged).select(F.transform("values", lambda x: x.cast("int")).alias("values"))


def regression(spark: SparkSession, path: str) -> DataFrame:
    """features, label: the last column is the label."""
    n = F.size("values")
    return vectors(spark, path).select(F.slice("values", F.lit(1), n - 1).alias("features"), F.element_at("values", -1).alias("label"))


def points(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Named double columns by position."""
    return vectors(spark, path).select(*(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)))


def identified(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """id (text) and named doubles, as in `id lat lon z`."""
    parts = lines(spark, path).select(tokens(F.trim("value")).alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("id"), *(number(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names, 1)))


def headered(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headered file with every column as text, trimmed."""
    df = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.withColumnsRenamed({c: c.strip() for c in df.columns})


def settings(spark: SparkSession, path: str, sep: str = r"\s+", unique: bool = False) -> DataFrame:
    """key, value: the first word of each line and the rest. Later keys win; they are an error if `unique`."""
    kv = numbered(spark, path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), sep, 2)
    rows = kv.select("path", "line", F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value"))
    if unique:
        return require_unique(rows.select("key", "value"), "key")
    return rows.groupBy("key").agg(F.max_by("value", F.struct("path", "line")).alias("value"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    return settings(spark, path, r"\s*[=:]\s*")


def setting(table: DataFrame, key: str, kind: str = "string", default=None):
    """One typed value; raises KeyError if it is missing and has no default, ValueError if it is of another type."""
    row = table.where(F.col("key") == key).select("value", F.col("value").try_cast(kind).alias("v")).first()
    if row is None:
        if default is None:
            raise KeyError(key)
        return default
    if row.v is None:
        raise ValueError(f"{key}: {row.value!r} is no {kind}")
    return row.v


def region_table(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """region, value_double, value_string of known regions; quoted values are text. Repeated regions are an error."""
    parts = F.split(F.trim("value"), r"\s*,\s*|\s+", 2)
    rows = lines(spark, path).select(F.get(parts, F.lit(0)).alias("region"), F.get(parts, F.lit(1)).alias("v"))
    quoted = F.col("v").startswith('"')
    typed = rows.select("region", F.when(~quoted, number(F.col("v"))).alias("value_double"), F.when(quoted, F.regexp_extract("v", '"([^"]*)"', 1)).alias("value_string"))
    return require_unique(typed.join(regions.select("region"), "region", "left_semi"), "region")


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """lati, loni, value of a text raster: a line with the box, one with columns and rows, then rows from the south."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    ranked = rows.where("line >= 2").select((F.col("line") - 2).alias("lati"), F.posexplode(tokens(F.trim("value"))).alias("loni", "v"))
    return ranked.select("lati", "loni", number(F.col("v")).alias("value"))


def ascii_grid_header(spark: SparkSession, path: str):
    """Grid of a text raster; the box is of cell centres and widens by half a step."""
    from lithos.operators.grid import Grid

    head = {r.line: r.p for r in numbered(spark, path).where("line < 2").select("line", tokens(F.trim("value")).alias("p")).collect()}
    south, north, west, east = map(float, head[0][:4])
    nx, ny = (int(head[1][0]), int(head[1][1])) if len(head[1]) > 1 else (int(head[1][0]), 0)
    dy, dx = (north - south) / max(ny - 1, 1), (east - west) / max(nx - 1, 1)
    return Grid(south - dy / 2, west - dx / 2, north - south + dy, east - west + dx, ny, nx)


def probability_grid(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """lati, loni, p; the first line is the northernmost row. Rows may be written [a, b, c]."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    top = rows.groupBy("path").agg(F.max("line").alias("top"))
    cells = rows.join(top, "path").select((F.col("top") - F.col("line")).cast("int").alias("lati"), F.posexplode(tokens(F.translate("value", "[],", "   "))).alias("loni", "v"))
    out = cells.select("lati", "loni", number(F.col("v")).alias("p"))
    if normalise:
        from lithos.operators.stats import shares

        out = shares(out, "p", None, "__q").select("lati", "loni", F.col("__q").alias("p"))
    return out


def graph(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    """src, dst, w of lines `node (neighbour weight)*`, or of neighbours alone with weight 1. Raises KeyError for a neighbour
    without a line."""
    parts = lines(spark, path).select(tokens(F.trim("value")).alias("p"))
    step = 2 if weighted else 1
    at = F.sequence(F.lit(1), F.size("p") - step, F.lit(step))
    pairs = parts.where(F.size("p") > step).select(F.get("p", F.lit(0)).alias("src"), F.explode(F.transform(at, lambda i: F.struct(F.get("p", i).alias("dst"), (F.get("p", i + 1).cast("double") if weighted else F.lit(1.0)).alias("w")))).alias("e"))
    edges = pairs.select("src", "e.dst", "e.w")
    return require_all(edges, parts.select(F.get("p", F.lit(0)).alias("dst")), "dst")


def weighted_mapping(spark: SparkSession, path: str) -> DataFrame:
    """r1, r2, w of lines `r1 , r2 : w , r2 : w`."""
    parts = F.split("value", ",")
    rows = lines(spark, path).select(F.trim(F.get(parts, F.lit(0))).cast("long").alias("r1"), F.explode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("e"))
    pair = F.split("e", ":")
    return rows.select("r1", F.trim(F.get(pair, F.lit(0))).cast("long").alias("r2"), F.trim(F.get(pair, F.lit(1))).cast("double").alias("w"))


def stock_bars(spark: SparkSession, path: str) -> DataFrame:
    """idx, d, open, high, low, close, volume, adjclose of lines `5 Jan 04 o h l c v a`; the first two and the last are left out."""
    rows = numbered(spark, path).where(F.trim("value") != "").select("path", "line", tokens(F.trim("value")).alias("p"))
    last = rows.groupBy("path").agg(F.max("line").alias("last"))
    kept = rows.join(last, "path").where("line >= 2 AND line < last")
    value = lambda i: F.get("p", F.lit(i))
    return kept.select((F.col("line") - 2).alias("idx"), day_month_year(value(0), value(1), value(2)).alias("d"), *(value(i).cast("double").alias(n) for i, n in ((3, "open"), (4, "high"), (5, "low"), (6, "close"))), F.regexp_replace(value(7), ",", "").cast("long").alias("volume"), value(8).cast("double").alias("adjclose"))


def observations(spark: SparkSession, path: str, observers: DataFrame) -> DataFrame:
    """rid, sid, ts, dbm, injected of lines `rid sid yyyy-MM-dd HH:mm:ss dbm`; a source ending in _p was injected. Unknown
    observers and a second day are errors."""
    p = tokens(F.trim("value"))
    rows = lines(spark, path).select(F.get(p, F.lit(0)).alias("rid"), F.get(p, F.lit(1)).alias("s"), F.to_timestamp_ntz(F.concat_ws(" ", F.get(p, F.lit(2)), F.get(p, F.lit(3))), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.get(p, F.lit(4)).cast("double").alias("dbm"))
    if rows.select(F.to_date("ts")).distinct().limit(2).count() > 1:
        raise ValueError("observations of more than one day")
    out = rows.select("rid", F.regexp_replace("s", "_p$", "").alias("sid"), "ts", "dbm", F.col("s").endswith("_p").alias("injected"))
    return require_all(out, observers.select("rid"), "rid")


#: Lines of a model log: parameters, time, misfit.
MODEL = r"^PARAMETERS:\s*(.*?)\s+TIME:\s*(\d+)\s+MISFIT:\s*(\S+)\s*$"


def parse_models(rows: DataFrame) -> DataFrame:
    """params, t, misfit of the well-formed lines (value) of a model log; others are dropped. For batches and streams."""
    part = lambda i: F.regexp_extract("value", MODEL, i)
    params = F.transform(tokens(part(1)), lambda x: x.try_cast("double"))
    parsed = rows.where(F.col("value").rlike(MODEL)).select(params.alias("params"), part(2).cast("long").alias("t"), part(3).try_cast("double").alias("misfit"))
    return parsed.where("misfit IS NOT NULL").where(F.forall("params", lambda x: x.isNotNull()))


def model_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_models(spark.read.text(path))


def model_bounds(spark: SparkSession, path: str) -> DataFrame:
    """dim, lo, hi of a log's header lines `bounds[i]: lo hi`."""
    pattern = r"bounds\[(\d+)\]:\s*(\S+)\s+(?:\.\.\.\s+)?(\S+)"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(part(1).cast("int").alias("dim"), part(2).cast("double").alias("lo"), part(3).cast("double").alias("hi"))


def density_file(spark: SparkSession, path: str) -> DataFrame:
    """dim, bin, cnt of a density file: lines `dim: lo ... hi` give bounds, the lines of numbers after them a dimension each."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    hist = rows.where(F.col("value").rlike(r"^\s*[-\d.][-\d.eE+\s]*$")).select("path", "line", tokens(F.trim("value")).alias("p"))
    first = hist.groupBy("path").agg(F.min("line").alias("first"))
    return hist.join(first, "path").select((F.col("line") - F.col("first")).alias("dim"), F.posexplode("p").alias("bin", "v")).select("dim", "bin", F.col("v").cast("double").alias("cnt"))


def kml_polygons(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """name, part, ring (array of (lat, lon)) of a KML file's placemarks; names in lower case with _ for spaces. Rings that don't
    close are an error in the caller's hands: `closed` says so."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark.*?</Placemark>"), F.lit(0))).alias("mark"))
    field = F.coalesce(F.nullif(F.regexp_extract("mark", rf'(?s)<SimpleData name="{name}">\s*(.*?)\s*</SimpleData>', 1), F.lit("")), F.regexp_extract("mark", rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1))
    blocks = whole.select(F.translate(F.lower(field), " ", "_").alias("name"), F.posexplode(F.regexp_extract_all("mark", F.lit(r"(?s)<coordinates>\s*(.*?)\s*</coordinates>"), F.lit(1))).alias("part", "text"))
    vertex = lambda t: F.struct(F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat"), F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"))
    rings = blocks.select("name", "part", F.transform(tokens("text"), vertex).alias("ring"))
    return rings.withColumn("closed", F.get("ring", F.lit(0)) == F.element_at("ring", -1))


def mif_polygons(spark: SparkSession, mif: str, mid: str) -> DataFrame:
    """name, part, ring of MIF regions, named by the second column of the MID line of the same number."""
    text = spark.read.text(mif, wholetext=True).select(F.regexp_replace("value", r"\r", "").alias("v"))
    regions = text.select(F.posexplode(F.slice(F.split("v", r"(?im)^\s*Region\s+\d+\s*$"), 2, 1_000_000)).alias("at", "body"))
    coords = r"(?m)^[ \t]*(-?\d+(?:\.\d+)?)[ \t]+(-?\d+(?:\.\d+)?)[ \t]*$"
    parts = regions.select("at", F.posexplode(F.filter(F.split("body", r"(?m)^[ \t]*\d+[ \t]*$"), lambda b: b.rlike(coords))).alias("part", "text"))
    number_of = lambda t, i: F.regexp_extract(t, coords, i).cast("double")
    ring = F.transform(F.regexp_extract_all("text", F.lit(coords), F.lit(0)), lambda t: F.struct(number_of(t, 2).alias("lat"), number_of(t, 1).alias("lon")))
    names = spark.read.text(mid, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    named = names.select("at", F.trim(F.translate(F.get(F.split("line", ","), F.lit(1)), '"', "")).alias("name"))
    return parts.join(named, "at").select("name", "part", ring.alias("ring"))


def profile_pages(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame:
    """path and the number on given lines of each profile page, commas and text around it removed."""
    rows = numbered(spark, path).where(F.col("line").isin(list(places.values())))
    n = F.regexp_replace(F.regexp_extract("value", r"(-?[\d,]+(?:\.\d+)?)\s*$", 1), ",", "").try_cast("double")
    return rows.groupBy("path").agg(*(F.max(F.when(F.col("line") == i, n)).alias(k) for k, i in places.items()))


def skims(spark: SparkSession, path: str, column: int) -> DataFrame:
    """orig, dest, time of lines with eight fields, the time in a column from 0."""
    p = tokens(F.trim("value"))
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") == 8).select(F.get("p", F.lit(0)).try_cast("long").alias("orig"), F.get("p", F.lit(1)).try_cast("long").alias("dest"), F.get("p", F.lit(column)).try_cast("double").alias("time")).where("orig IS NOT NULL")


def census_districts(spark: SparkSession, path: str, south=-90.0, north=90.0, west=-180.0, east=180.0) -> DataFrame:
    """district, area, lat, lon of lines that end in `district _ area long lat`, within a box and with an area; a district's
    first line counts."""
    p = tokens(F.trim("value"))
    back = lambda i: F.try_element_at(p, F.lit(-i))
    rows = numbered(spark, path).select("path", "line", back(5).try_cast("long").alias("district"), back(3).try_cast("double").alias("area"), back(2).try_cast("double").alias("lon"), back(1).try_cast("double").alias("lat"))
    kept = rows.where("district IS NOT NULL AND area > 0").where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return kept.groupBy("district").agg(F.min_by(F.struct("area", "lat", "lon"), F.struct("path", "line")).alias("r")).select("district", "r.*")


def postcodes(spark: SparkSession, path: str) -> DataFrame:
    """postcode and its suburbs (lower case, _ for spaces) of lines `postcode,suburb`."""
    from lithos.functions.text import plain_name

    p = F.split("value", ",")
    rows = lines(spark, path).select(F.trim(F.get(p, F.lit(0))).alias("postcode"), plain_name(F.get(p, F.lit(1))).alias("suburb"))
    return rows.groupBy("postcode").agg(F.sort_array(F.collect_set("suburb")).alias("suburbs"))


def single_match(rows: DataFrame, text: str) -> str:
    """The one line that holds a text, in any case; ValueError if there isn't exactly one."""
    found = rows.where(F.contains(F.lower("value"), F.lit(text.lower()))).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} line holds {text!r}" if len(found) < 2 else f"several lines hold {text!r}")
    return found[0].value


def line_of(rows: DataFrame, text: str, fold: bool = False) -> int:
    """Number of the first line that holds a text; -1 if none does."""
    value = F.lower("value") if fold else F.col("value")
    found = rows.where(F.contains(value, F.lit(text.lower() if fold else text))).agg(F.min("line")).first()[0]
    return -1 if found is None else found


def models_by_width(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """params, misfit of lines that hold `dims` numbers and a misfit, with or without words between them; others are dropped."""
    numbers = F.transform(F.regexp_extract_all("value", F.lit(r"(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])"), F.lit(0)), lambda x: x.cast("double"))
    rows = lines(spark, path).select(numbers.alias("p")).where(F.size("p") == dims + 1)
    return rows.select(F.slice("p", 1, dims).alias("params"), F.element_at("p", -1).alias("misfit"))


def first_lines(rows: DataFrame, key: Column) -> DataFrame:
    """path, key and the number of its first line in each file of numbered()."""
    return rows.select("path", "line", key.alias("key")).where("key IS NOT NULL AND key <> ''").groupBy("path", "key").agg(F.min("line").alias("line"))


def in_order(keys: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key of a list, in the list's order; KeyError if one has none."""
    return require_all(keys, table.select(key), key).join(table.select(key, value), key).orderBy(order)


def complete_records(rows: DataFrame, line: int, marker: str) -> DataFrame:
    """Lines of the files of numbered() that don't carry a marker of an incomplete record on a given line."""
    bad = rows.where((F.col("line") == line) & F.contains("value", F.lit(marker))).select("path")
    return rows.join(bad, "path", "left_anti")
