import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators.grid import Grid
from lithos.sources import gis, raster

GRID = Grid(-34.0, 150.0, 1.0, 2.0, 50, 21)


def cells(spark, value):
    rows = spark.range(50 * 21).select((F.col("id") / 21).cast("int").alias("lati"), (F.col("id") % 21).cast("int").alias("loni"))
    return rows.select(F.lit("here").alias("layer"), "lati", "loni", value.cast("double").alias("value"))


@pytest.mark.parametrize("kind, value", [("CONTINUOUS", "if(loni % 5 != 0, lati + loni / 8, null)"), ("CATEGORICAL", "if(lati % 3 != 0, loni % 4, null)"), ("BINARY", "(lati * loni) % 2")])
def test_round_trip(spark, tmp_path, kind, value):
    wanted = cells(spark, F.expr(value))
    gis.write_cells(wanted, GRID, kind, str(tmp_path), band_cells=200)
    found = gis.read_cells(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 6  # bands of nine rows
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    # the file is one that the plain decoder of the format reads, and a reader of gzip one stream
    grid, values, its_kind, name, _ = raster.decode((tmp_path / "here.gis").read_bytes())
    assert (grid, its_kind, name) == (GRID, kind, "here")
    plain = {(r.lati, r.loni): r.value for r in wanted.collect()}
    assert all((v is None and np.isnan(values[k])) or v == values[k] for k, v in plain.items())


def test_filters_reach_the_bands(spark, tmp_path):
    gis.write_cells(cells(spark, F.col("lati") * 100 + F.col("loni")), GRID, "CONTINUOUS", str(tmp_path), band_cells=200)
    some = gis.read_cells(spark, str(tmp_path)).where("lati >= 20 AND lati < 25 AND loni = 3 AND value > 2103")
    assert some.rdd.getNumPartitions() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "value" in plan.split("Filter")[1] and "lati" not in plan.split("Filter")[1].split("\n")[0]
    assert sorted(r.value for r in some.collect()) == [2203.0, 2303.0, 2403.0]
    assert gis.read_cells(spark, str(tmp_path)).where("lati > 90").collect() == []


def test_files_of_others(spark, tmp_path):
    values = np.arange(12.0).reshape(4, 3)
    values[1, 2] = np.nan
    small = Grid(0.0, 0.0, 4.0, 3.0, 4, 3)
    one = raster.encode(small, values, "CONTINUOUS", "one", ["a", "b"])
    (tmp_path / "one.gis").write_bytes(one)
    at = one.index(struct.pack(">i", raster.MAGIC)) + 4
    raw = one[:at].replace(b"name one", b"name two").replace(b"latsize 4.0", b"maxlat 4.0") + gzip.decompress(one[at:])
    (tmp_path / "two.gis").write_bytes(raw)
    rows = gis.read_cells(spark, str(tmp_path)).collect()
    for name in ("one", "two"):
        assert sorted((r.lati, r.loni, r.value) for r in rows if r.layer == name and r.value is not None) == [(i, j, i * 3.0 + j) for i in range(4) for j in range(3) if (i, j) != (1, 2)]
    heads = {r.layer: r for r in gis.read_heads(spark, str(tmp_path)).collect()}
    assert heads["two"].latsize == 4.0 and heads["one"].categories == ["a", "b"] and heads["one"].kind == "CONTINUOUS"
    (tmp_path / "three.gis").write_bytes(raw[: at - 4] + b"\0" * 8)
    with pytest.raises(Exception, match="magic"):
        gis.read_cells(spark, str(tmp_path)).collect()


def test_large_file_by_many_tasks(spark, tmp_path):
    big = Grid(0.0, 0.0, 1.0, 1.0, 3000, 4000)
    rows = spark.range(0, 3000 * 4000, 7).select(F.lit("big").alias("layer"), (F.col("id") / 4000).cast("int").alias("lati"), (F.col("id") % 4000).cast("int").alias("loni"), (F.col("id") % 1000).cast("double").alias("value"))
    gis.write_cells(rows, big, "CONTINUOUS", str(tmp_path))
    found = gis.read_cells(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 12
    assert found.agg(F.sum("value"), F.count("value"), F.count(F.lit(1))).first() == (*rows.agg(F.sum("value"), F.count("value")).first(), 12_000_000)
