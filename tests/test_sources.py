"""Readers and writers: round trips and their errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators.grid import Grid
from lithos.sources import raster, sinks, store, text
from lithos.streaming import models as M


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_vectors(spark, tmp_path):
    p = write(tmp_path / "v", "# c\n1 2 nan\n\n3 4 5\n")
    assert sorted(map(str, text.vectors(spark, p).collect())) == ["Row(values=[1.0, 2.0, None])", "Row(values=[3.0, 4.0, 5.0])"]
    assert text.regression(spark, p).agg(F.sum("label")).first()[0] == 5
    with pytest.raises(ValueError):
        text.vectors(spark, write(tmp_path / "w", "1 2\n3\n"))
    with pytest.raises(ValueError):
        text.vectors(spark, write(tmp_path / "e", "# nothing\n"))
    assert text.vectors(spark, str(tmp_path / "w"), ragged=True).count() == 2


def test_settings(spark, tmp_path):
    t = text.settings(spark, write(tmp_path / "s", "a 1\nb two words\na 3\n"))
    assert text.setting(t, "a", "int") == 3 and text.setting(t, "b") == "two words" and text.setting(t, "c", default=7) == 7
    with pytest.raises(KeyError):
        text.setting(t, "c")
    with pytest.raises(ValueError):
        text.setting(t, "b", "int")
    with pytest.raises(ValueError):
        text.settings(spark, str(tmp_path / "s"), unique=True)


def test_grids(spark, tmp_path):
    grid = Grid(0.0, 10.0, 2.0, 3.0, 2, 3)
    cells = spark.createDataFrame([(0, 0, 1.5), (1, 2, -2.0)], "lati int, loni int, value double")
    lines = [r.value for r in sinks.ascii_grid_lines(cells, grid).orderBy("line").collect()]
    p = write(tmp_path / "g", "\n".join(lines))
    assert text.ascii_grid_header(spark, p) == grid
    assert {r[:] for r in text.ascii_grid(spark, p).where("value IS NOT NULL").collect()} == {(0, 0, 1.5), (1, 2, -2.0)}
    top = text.probability_grid(spark, write(tmp_path / "p", "[0, 1]\n[3, 0]\n"), True)
    assert {(r.lati, r.loni): r.p for r in top.collect() if r.p} == {(1, 1): 0.25, (0, 0): 0.75}


@pytest.mark.parametrize("kind", ["BINARY", "CATEGORICAL", "CONTINUOUS"])
def test_raster_round_trip(spark, tmp_path, kind):
    grid = Grid(-1.0, 2.0, 3.0, 5.0, 3, 10)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2, (3, 10)).astype(float)
    if kind != "BINARY":
        values[1, 3] = np.nan
    cells = spark.createDataFrame([("one", i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(values)], raster.CELLS)
    content = raster.encoded(cells, grid, kind).first().content
    write(tmp_path / "one.gis", bytes(content))
    back = np.full((3, 10), np.nan)
    for r in raster.read_rasters(spark, str(tmp_path)).collect():
        back[r.lati, r.loni] = np.nan if r.value is None else r.value
    assert np.array_equal(back, values, equal_nan=True)
    assert raster.decode(bytes(content))[0] == grid


def test_graph_and_mapping(spark, tmp_path):
    edges = text.graph(spark, write(tmp_path / "g", "a b 1.5 c 2\nb a 1.5\nc\n"))
    assert {r[:] for r in edges.collect()} == {("a", "b", 1.5), ("a", "c", 2.0), ("b", "a", 1.5)}
    with pytest.raises(KeyError):
        text.graph(spark, write(tmp_path / "h", "a b 1\n"))
    m = text.weighted_mapping(spark, write(tmp_path / "m", "1 , 2 : 0.5 , 3 : 0.5\n"))
    assert sinks.mapping_lines(m).first().value == "1 , 2 : 0.5 , 3 : 0.5"


def test_stock_and_observations(spark, tmp_path):
    bars = "".join(f"{d} Jan 04 1 2 0.5 1.5 1,000 1.5\n" for d in range(1, 7))
    assert [r.idx for r in text.stock_bars(spark, write(tmp_path / "s", bars)).orderBy("idx").collect()] == [0, 1, 2]
    observers = spark.createDataFrame([("r1",)], "rid string")
    rows = text.observations(spark, write(tmp_path / "o", "r1 s1_p 2013-05-01 10:00:00 -50\n"), observers).collect()
    assert rows[0].sid == "s1" and rows[0].injected
    with pytest.raises(KeyError):
        text.observations(spark, write(tmp_path / "o2", "r9 s1 2013-05-01 10:00:00 -50\n"), observers)
    with pytest.raises(ValueError):
        text.observations(spark, write(tmp_path / "o3", "r1 s 2013-05-01 10:00:00 -5\nr1 s 2013-05-02 10:00:00 -5\n"), observers)


def test_kml_and_mif(spark, tmp_path):
    ring = spark.createDataFrame([("a_zone", [(0.0, 1.0), (0.0, 2.0), (1.0, 2.0), (0.0, 1.0)])], "name string, ring array<struct<lat: double, lon: double>>")
    p = write(tmp_path / "k.kml", sinks.kml(sinks.polygons(ring)))
    back = text.kml_polygons(spark, p).first()
    assert back.closed and back.name == "a_zone" and back.ring == ring.first().ring
    mif = write(tmp_path / "z.mif", "Region 1\n4\n1 0\n2 0\n2 1\n1 0\nPen (1,2,0)\n")
    mid = write(tmp_path / "z.mid", '1,"Zone A"\n')
    assert text.mif_polygons(spark, mif, mid).first().ring == ring.first().ring


def test_model_log_and_stream(spark, tmp_path):
    log = "NumDimensions: 2\nbounds[0]: 0.0 ... 1.0\nBEGIN MODELS\nPARAMETERS: 0.1 0.2 TIME: 5 MISFIT: 2.5\nbroken\nPARAMETERS: 0.3 0.4 TIME: 6 MISFIT: 1.5\n"
    p = write(tmp_path / "log" / "a", log)
    models = text.model_log(spark, p)
    assert models.count() == 2 and text.model_bounds(spark, p).first()[:] == (0, 0.0, 1.0)
    assert [r.value for r in sinks.model_lines(models.where("t = 5")).collect()] == ["PARAMETERS: 0.1 0.2 TIME: 5 MISFIT: 2.5"]
    tail = M.running_best(M.tail(spark, str(tmp_path / "log")))
    q = tail.writeStream.outputMode("complete").format("memory").queryName("best_of_log").option("checkpointLocation", str(tmp_path / "best")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("best_of_log").first()[:3] == (2, 1.5, 6)


def test_store(spark, tmp_path):
    grid = Grid(0.0, 0.0, 1.0, 2.0, 1, 2)
    write(tmp_path / "gis" / "tz" / "membership.gis", raster.encode(grid, np.array([[0.0, 1.0]]), "CATEGORICAL", "tz", ["north", "south"]))
    write(tmp_path / "gis" / "tz" / "people" / "income.tab", "north 5.5\nsouth 6\nelsewhere 7\n")
    write(tmp_path / "gis" / "tz" / "label.csv", 'north,"a name"\n')
    write(tmp_path / "globals" / "g", "year 2001\n")
    s = store.Store(spark, str(tmp_path))
    s.check()
    assert store.request(s, "getValueForRegion tz people/income north") == "5.5"
    assert store.request(s, "getValueForRegion tz label north") == "a name"
    assert store.request(s, "listRegions tz") == "north south" and store.request(s, "getGlobal year") == "2001"
    assert store.request(s, "getValueForRegion tz").startswith("ERROR") and store.request(s, "nonsense").startswith("ERROR")
    assert store.request(s, "getValueForRegion tz people/income elsewhere").startswith("ERROR")
    at = s.values_at("tz", "people/income", spark.createDataFrame([(0.5, 1.5)], "lat double, lon double")).first()
    assert at.region == "south" and at.value_double == 6


@pytest.mark.parametrize(("cells", "fits"), [([0.0, 2.0], True), ([2.0, 2.0], True), ([0.0, 3.0], False), ([0.5, 1.0], False), ([-1.0, 1.0], False)])
def test_store_checks_ids_of_cells(spark, tmp_path, cells, fits):
    """Regions without a cell are fine (the second has none here); cells of regions that have no name aren't."""
    write(tmp_path / "gis" / "tz" / "membership.gis", raster.encode(Grid(0.0, 0.0, 1.0, 2.0, 1, 2), np.array([cells]), "CONTINUOUS", "tz", ["north", "middle", "south"]))
    write(tmp_path / "gis" / "tz" / "income.tab", "north 5.5\n")
    s = store.Store(spark, str(tmp_path))
    if fits:
        s.check()
    else:
        with pytest.raises(ValueError):
            s.check()
