"""Elevation files made by the test, read by the ingest job; GeoJSON documents; presets."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelens.functions import grid
from ridgelens.operators import raster
from ridgelens.sources import dem, landmarks

SIDE, TILE = 128, 80


def write(path, z, **change):
    path.write_bytes(dem.encode_file(z, TILE, magic=change.pop("magic", b"II*\0"), tags={int(k[1:]): v for k, v in change.items()}))


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    z = rng.normal(1000, 300, (SIDE, SIDE)).astype(np.float32)
    write(tmp_path / "X_N44_00_E006_00_DEM.tif", z)
    write(tmp_path / "X_S02_00_W011_00_DEM.tif", z[::-1])
    for k, change in enumerate([{"magic": b"MM\0*"}, {"_258": 16}, {"_259": 5}, {"_277": 3}, {"_317": 2}, {"_256": 100}]):
        write(tmp_path / f"X_N1{k}_00_E006_00_DEM.tif", z, **change)
    write(tmp_path / "stray_DEM.tif", z)
    return tmp_path, z


def test_ingest(spark, folder, tmp_path_factory):
    path, z = folder
    out = str(tmp_path_factory.mktemp("blocks") / "dem")
    blocks, rejects = dem.ingest(spark, str(path), out, width=SIDE)
    assert rejects.count() == 7 and rejects.where("path like '%stray%' and reason = 'the name tells no cell'").count() == 1
    px = {(r.ilat, r.ilon): r.h for r in dem.pixels(blocks).collect()}
    assert len(px) == 2 * SIDE * SIDE
    for r, c in ((0, 0), (79, 80), (80, 79), (127, 127), (64, 3)):
        assert px[3600 * 45 - 1 - r, 3600 * 6 + c] == float(z[r, c])
        assert px[3600 * -1 - 1 - r, 3600 * -11 + c] == float(z[SIDE - 1 - r, c])
    assert spark.read.parquet(out).where("cell_lat = 44 and not broken").count() == (SIDE // grid.BLOCK) ** 2

    # a window reads what ingest wrote, and of the cells only those it touches
    at = spark.createDataFrame([(1, 45 - 40.5 / 3600, 6 + 60.5 / 3600)], "vp_id bigint, lat double, lon double")
    got = {(r.row, r.col): r.h for r in raster.window_mosaic(at, blocks, 32).collect()}
    top, left = 3600 * 45 - 1 - max(r.ilat for r in raster.window_mosaic(at, blocks, 32).collect()), 60 - 16
    assert len(got) == 32 * 32 and all(h == float(z[top + r, left + c]) for (r, c), h in got.items())


def test_refresh_decodes_what_is_new(spark, folder, tmp_path):
    """Only cells asked for, nothing twice, and a changed file alone replaces its cell."""
    path, z = folder
    out, small = str(tmp_path / "held"), {"width": SIDE}
    cells = lambda rows: spark.createDataFrame(rows, "cell_lat int, cell_lon int")
    pixel = lambda blocks, lat: {(r.ilat, r.ilon): r.h for r in dem.pixels(blocks.where(F.col("cell_lat") == lat)).collect()}
    assert dem.refresh(spark, str(path), out, needed=cells([(9, 9)]), **small)[2] == 0
    blocks, files, n = dem.refresh(spark, str(path), out, needed=cells([(44, 6), (9, 9)]), **small)
    assert n == 1 and files.count() == 1 and blocks.select("cell_lat").distinct().count() == 1
    blocks, files, n = dem.refresh(spark, str(path), out, **small)
    assert n == 8 and files.where("reason is not null").count() == 7 and blocks.count() == 2 * (SIDE // grid.BLOCK) ** 2
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "held").rglob("*.parquet"))}
    assert dem.refresh(spark, str(path), out, **small)[2] == 0
    write(path / "X_N44_00_E006_00_DEM.tif", z + 1)
    blocks, files, n = dem.refresh(spark, str(path), out, **small)
    assert n == 1 and pixel(blocks, 44)[3600 * 45 - 1, 3600 * 6] == float(z[0, 0] + np.float32(1)) and pixel(blocks, -2)[3600 * -1 - 1, 3600 * -11] == float(z[SIDE - 1, 0])
    after = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "held").rglob("*.parquet"))}
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "broken=false/cell_lat=44" in f}
    write(path / "X_N44_00_E006_00_DEM.tif", z, magic=b"MM\0*")
    blocks, files, n = dem.refresh(spark, str(path), out, **small)
    assert n == 1 and len(pixel(blocks, 44)) == SIDE * SIDE


def test_catalogue(spark, folder):
    rows = {(r.cell_lat, r.cell_lon) for r in dem.catalogue(spark, str(folder[0])).collect()}
    assert {(44, 6), (-2, -11)} <= rows


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"name":"A","name:fr":"B","ele":"12.5"},"geometry":{"coordinates":[6.5,44.5]}},{"properties":{"ele":"3"},"geometry":{"coordinates":[1,2]}},{"properties":{"name":"C","ele":"n/a"},"geometry":{"coordinates":[7,45]}},{"properties":{"name":"D"},"geometry":{"coordinates":[7]}}]}')
    rows = landmarks.read_geojson(spark, str(tmp_path / "a.json")).orderBy("ord").collect()
    assert [(r.ord, r.name, r.lat, r.lon, r.elevation, r.bad_elevation) for r in rows] == [(0, "B", 44.5, 6.5, 13, False), (2, "C", 45.0, 7.0, None, True)]


def test_geojson_rejects(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"features":[{"properties":{"ele":"3"},"geometry":{"coordinates":[1,2]}},{"properties":{"name":"D"},"geometry":{"coordinates":[7]}},{"properties":{"name":"E"}},{"properties":{"name":"F"},"geometry":{"coordinates":[7,8]}}]}'), (2, '{"features":[{"pro'), (3, None), (4, "[]"), (5, '{"features":[]}'), (6, '{"other":1}')], "doc int, json string")
    got = sorted((r.doc, r.ord if r.ord is not None else -1, r.reason) for r in landmarks.rejected_geojson(docs, keep=("doc",)).collect())
    none = "no document of features"
    assert got == [(1, 0, "no name"), (1, 1, "not two coordinates"), (1, 2, "not two coordinates"), (2, -1, none), (3, -1, none), (4, -1, none), (6, -1, none)]
    (tmp_path / "l.json").write_text('{"properties":{"name":"A"},"geometry":{"coordinates":[6.5,44.5]}}\n\n{"properties":{"na\n{"properties":{"name":"B","ele":"7.5"},"geometry":{"coordinates":[6,44]}}\n')
    good, bad = landmarks.read_geojson_lines(spark, str(tmp_path / "l.json"))
    assert [(r.name, r.lat, r.elevation) for r in good.orderBy("ord").collect()] == [("A", 44.5, None), ("B", 44.0, 8)] and [r.reason for r in bad.collect()] == [none]


def test_elevations_that_no_int_holds(spark):
    df = spark.createDataFrame([("12.4",), ("-0.6",), ("NaN",), ("Infinity",), ("1e12",), ("n/a",), (None,)], "ele string")
    assert [r[0] for r in df.select(landmarks.elevation(F.col("ele"))).collect()] == [12, 0, None, None, None, None, None]


def test_presets(spark):
    assert landmarks.presets(spark).count() == len(landmarks.PRESETS)
