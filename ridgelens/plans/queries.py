"""The registered queries, each on its fixtures with fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.functions import grid
from ridgelens.operators import coverage, labels, raster, sight
from ridgelens.plans import jobs
from ridgelens.plans.fixtures import fixture
from ridgelens.sources import dem, landmarks, sinks
from ridgelens.sources.scratch import scratch
from ridgelens.streaming import pose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Sizes of the windows, in pixels.
WINDOW, PREFETCH, VIEW, LINES, PANORAMA, BOX = 2048, 6144, 64, 256, 128, (44.98, 6.99, 45.01, 7.01)
ASPECT, UPRIGHT, FILE, VIEWERS = 4 / 3, 3 / 4, 256, 25


def query(f: Callable) -> Callable:
    """Registers f(fx), which gets its fixtures by name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: fixture(spark, sf_dir, f"fx_{name}"))
    return f


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def blocks(fx) -> DataFrame:
    return raster.to_blocks(fx("dem"))


def _position(fx) -> DataFrame:
    return fx("position").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


@query
def window_range(fx):
    w = grid.window_range(F.col("lat"), F.col("lon"), WINDOW)
    return _position(fx).select("device_id", *[c.alias(n) for n, c in w.items()])


@query
def coverage_predicate(fx):
    at = F.col("lat"), F.col("lon"), WINDOW
    return _position(fx).select("device_id", grid.in_range(*at).alias("intent"), grid.in_range(*at, compat=True).alias("compat"))


@query
def viewpoint_resolve(fx):
    return coverage.resolve_viewpoints(fx("position"), WINDOW)


@query
def cell_requirement(fx):
    return coverage.cell_requirement(fx("position"), WINDOW)


@query
def coverage_gap(fx):
    return coverage.coverage_gap(fx("position"), fx("cell"), PREFETCH)


def _documents(fx) -> DataFrame:
    """Landmarks as GeoJSON, a hundred in a document."""
    p = fx("poi").withColumn("doc", F.floor(F.col("ord") / 100).cast("int"))
    feature = F.struct("ord", F.struct(F.struct("name", F.col("name_fr").alias("name:fr"), "ele").alias("properties"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry")).alias("f"))
    return p.groupBy("doc").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(feature)), lambda x: x["f"]).alias("features"))).alias("json"))


def _elevation_files(fx) -> DataFrame:
    """(path, content) of elevation files, one for each cell."""

    def make(key: tuple, px: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((FILE, FILE), np.float32)
        z[px.r, px.c] = px.h
        return pd.DataFrame({"path": [f"X_N{key[0]:02d}_00_E{key[1]:03d}_00_DEM.tif"], "content": [dem.encode_file(z, 96)]})

    return fx("file_px").groupBy("cell_lat", "cell_lon").applyInPandas(make, "path string, content binary")


@query
def poi_load(fx):
    return landmarks.parse_geojson(_documents(fx), keep=("doc",))


@query
def poi_rejects(fx):
    """What the same documents lose, with every seventh one cut short."""
    return landmarks.rejected_geojson(_documents(fx).withColumn("json", F.when(F.col("doc") % 7 == 3, F.expr("left(json, length(json) - 3)")).otherwise(F.col("json"))), keep=("doc",))


@query
def dem_ingest(fx):
    """Elevation files made of orders' prices, decoded to pixels."""
    return dem.pixels(dem.decode_files(_elevation_files(fx), width=FILE).where("reason is null")).where("h > 0")


@query
def dem_catalogue(fx):
    """Cells told by names of files, south and west included."""
    side = lambda c, plus, minus, width: F.concat(F.when(F.col(c) < 0, minus).otherwise(plus), F.lpad(F.abs(c).cast("string"), width, "0"))
    places = _position(fx).select("device_id", F.floor("lat").cast("int").alias("a"), F.floor("lon").cast("int").alias("b"))
    names = places.select("device_id", F.concat(F.lit("dem/Copernicus_DSM_COG_10_"), side("a", "N", "S", 2), F.lit("_00_"), side("b", "E", "W", 3), F.lit("_00_DEM.tif")).alias("path"))
    return names.select("device_id", *dem.cell_of(F.col("path")))


@query
def poi_extract(fx):
    p = fx("poi")
    tags = F.map_from_arrays(F.array(*map(F.lit, ("natural", "name", "name:fr", "ele"))), F.array("kind", "name", "name_fr", "ele"))
    return landmarks.extract_landmarks(p.select(F.col("poi_id").alias("node_id"), "lat", "lon", tags.alias("tags")), BOX)


@query
def poi_in_view(fx):
    return sight.in_view(fx("vp"), jobs.clean_landmarks(fx("poi")), VIEW).select("vp_id", "poi_id")


@query
def poi_pixel(fx):
    pairs = sight.in_view(fx("vp"), jobs.clean_landmarks(fx("poi")), VIEW)
    at = F.col("lat"), F.col("lon"), F.col("vp_lat"), F.col("vp_lon"), VIEW
    (wx, wy), (sx, sy) = grid.landmark_pixel(*at), grid.landmark_pixel(*at, "sdl")
    return pairs.select("vp_id", "poi_id", wx.alias("web_x"), wy.alias("web_y"), sx.alias("sdl_x"), sy.alias("sdl_y"))


@query
def pixel_address(fx):
    a = grid.pixel_address(grid.arc(F.col("lat")), grid.arc(F.col("lon")))
    return _rounded(jobs.clean_landmarks(fx("poi")).select("poi_id", *[c.alias(n) for n, c in a.items()]), "box_lat", "box_lon", "box_lat_hi", "box_lon_hi")


@query
def poi_height(fx):
    p = jobs.clean_landmarks(fx("poi")).select("poi_id", grid.arc(F.col("lat")).alias("ilat"), grid.arc(F.col("lon")).alias("ilon"))
    return raster.sample_heights(p, blocks(fx))


@query
def window_mosaic(fx):
    return raster.window_mosaic(fx("vp"), blocks(fx), VIEW)


def _exact(fx, size: int, heights: DataFrame | None = None) -> DataFrame:
    return jobs.pairs_in_view(fx("vp"), jobs.clean_landmarks(fx("poi")), size, "exact", heights)


@query
def sight_line_cells(fx):
    return sight.sight_line_cells(_exact(fx, VIEW)).select("vp_id", "poi_id", "k", "ilat", "ilon")


@query
def line_of_sight(fx):
    heights = blocks(fx)
    return sight.line_of_sight(_exact(fx, LINES, heights), heights)


@query
def visible_poi(fx):
    heights = blocks(fx)
    return sight.visible_landmarks(_exact(fx, LINES, heights), heights).select("vp_id", "poi_id")


@query
def sight_work(fx):
    heights = blocks(fx)
    return sight.sight_work(_exact(fx, LINES, heights), heights)


@query
def gradient(fx):
    return _rounded(raster.gradient(blocks(fx)), "gx", "gy").select("ilat", "ilon", "gx", "gy")


@query
def gradient_arrow(fx):
    """gradient by the numpy kernel over bordered blocks."""
    return _rounded(raster.gradient(blocks(fx), form="arrow"), "gx", "gy").select("ilat", "ilon", "gx", "gy")


@query
def normals(fx):
    return raster.normals(raster.gradient(blocks(fx))).select("ilat", "ilon", "nx", "ny", "nz")


@query
def hillshade_nw(fx):
    return raster.hillshade_nw(raster.gradient(blocks(fx))).select("ilat", "ilon", "grey")


@query
def hillshade_relief(fx):
    return _rounded(raster.hillshade_relief(raster.gradient(blocks(fx))), "light").select("ilat", "ilon", "light")


@query
def gradient_pyramid(fx):
    out = raster.gradient_pyramid(raster.gradient(blocks(fx)), raster.pyramid_levels(100))
    return out.withColumns({c: F.round(F.col(c), 12) + F.lit(0.0) for c in ("gx", "gy")})


def _pairs(fx, variant: str = "web") -> DataFrame:
    """Pairs in view with heights at both ends."""
    return jobs.pairs_in_view(fx("vp"), jobs.clean_landmarks(fx("poi")), PANORAMA, variant, blocks(fx)).where(F.col("vh").isNotNull() & F.col("ph").isNotNull())


def _ranked(fx) -> DataFrame:
    posed = {"alpha": F.col("heading"), "beta": F.lit(90.0), "gamma": F.lit(0.0), "screen": F.lit(0.0)}
    return labels.ranked(_pairs(fx), labels.prominence()).withColumns(posed)


@query
def poi_rank(fx):
    return _rounded(labels.ranked(_pairs(fx), labels.prominence()).withColumn("prominence", labels.prominence()), "prominence").select("vp_id", "poi_id", "prominence", "nth")


@query
def poi_rank_depth(fx):
    return _rounded(labels.ranked(labels.project_yaw(_pairs(fx, "sdl")), "v"), "v").select("vp_id", "poi_id", "v", "nth")


@query
def poi_project(fx):
    out = labels.on_screen(labels.project(_ranked(fx)), F.lit(ASPECT))
    return _rounded(out.select("vp_id", "poi_id", "u", "v", "sx", "sy", "inclination"), "u", "v", "sx", "sy", "inclination")


@query
def poi_project_tilted(fx):
    tilted = {"beta": 60 + F.col("vp_id") % 3 * 15.0, "gamma": F.col("vp_id") % 4 * 10.0, "screen": F.col("vp_id") % 2 * 90.0}
    out = labels.on_screen(labels.project(_ranked(fx).withColumns(tilted)), F.lit(UPRIGHT))
    return _rounded(out.select("vp_id", "poi_id", "u", "v", "sx", "sy", "inclination"), "u", "v", "sx", "sy", "inclination")


@query
def poi_project_yaw(fx):
    return _rounded(labels.project_yaw(_pairs(fx, "sdl")).select("vp_id", "poi_id", "u", "v"), "u", "v")


@query
def label_thin(fx):
    return labels.thin(labels.project(_ranked(fx))).select("vp_id", "poi_id", "nth", "shown")


@query
def label_thin_drop(fx):
    return labels.thin(labels.ranked(labels.project_yaw(_pairs(fx, "sdl")), "v"), variant="sdl").select("vp_id", "poi_id", "nth")


@query
def label_text(fx):
    return jobs.clean_landmarks(fx("poi")).select("poi_id", labels.label_text(F.col("name"), F.col("elevation")).alias("text"))


@query
def pose_latest(fx):
    return pose.latest(fx("orientation"))


@query
def pose_frames(fx):
    return pose.frames(fx("orientation").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("frame_start", F.date_format("frame_start", "yyyy-MM-dd"))


@query
def pose_changes(fx):
    return pose.changes(fx("orientation")).select("event_id", "device_id", *pose.ANGLES)


@query
def pose_from_keys(fx):
    return pose.from_keys(fx("key"))


@query
def panorama_labels(fx):
    out = jobs.panorama_labels(fx("vp"), jobs.clean_landmarks(fx("poi")), blocks(fx), size=PANORAMA, aspect=ASPECT)
    return _rounded(out, "u", "v", "sx", "sy")


@query
def panorama_labels_drop(fx):
    out = jobs.panorama_labels(fx("vp"), jobs.clean_landmarks(fx("poi")), blocks(fx), size=PANORAMA, variant="sdl", aspect=ASPECT)
    return _rounded(out, "u", "v", "sx", "sy")


@query
def panorama_full_window(fx):
    """Lines as long as the browser's window has them."""
    out = jobs.panorama_labels(fx("wide_vp"), jobs.clean_landmarks(fx("wide_poi")), raster.to_blocks(fx("wide_dem")), size=WINDOW, aspect=ASPECT)
    return _rounded(out, "u", "v", "sx", "sy")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


@query
def labels_written(fx):
    """Labels as batches leave them: two batches of views, the first of which runs twice."""
    out = jobs.panorama_labels(fx("vp"), jobs.clean_landmarks(fx("poi")), blocks(fx), size=PANORAMA, aspect=ASPECT).persist()
    path = scratch(out.sparkSession, "labels")
    for batch in (0, 1, 0):
        sinks.write_labels(out.where(F.col("vp_id") % 2 == batch), path, batch)
    held = sinks.read_batches(out.sparkSession, path, _schema(out))
    out.unpersist()
    return _rounded(held.select(*out.columns), "u", "v", "sx", "sy")


@query
def pose_stream(fx):
    """Orientation files as a stream: changes, kept by device, written batch by batch and read again."""
    batch = fx("orientation").withColumn("ts", F.col("ts").cast("timestamp"))
    spark = batch.sparkSession
    source, out = scratch(spark, "samples"), scratch(spark, "changes")
    batch.write.parquet(source)
    stream = pose.changes_stream(pose.read_stream(spark, source)).writeStream.option("checkpointLocation", scratch(spark, "stream"))
    stream.foreachBatch(sinks.batch_sink(out)).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_batches(spark, out, pose.ORIENTATION).select("event_id", "device_id", *pose.ANGLES)


@query
def labels_stream(fx):
    """Orientation files as a stream: labels of each sample that changes its device's pose, written batch by batch and read again.

    A device stands at the viewpoint of its id modulo VIEWERS.  Samples are written with their view, a viewpoint and a
    pose; its labels are written once for each batch, and meet its samples when they are read.
    """
    samples = fx("orientation").withColumn("ts", F.col("ts").cast("timestamp"))
    spark = samples.sparkSession
    source, views, looks, found = (scratch(spark, name) for name in ("samples", "visible", "looks", "labels"))
    samples.write.parquet(source)
    seen = jobs.seen_from(fx("vp"), jobs.clean_landmarks(fx("poi")), blocks(fx), size=VIEW)
    sinks.write_visible(seen, views)  # once, for all batches
    seen = sinks.read_batches(spark, views, _schema(seen))
    stream = jobs.relabel_views(pose.read_stream(spark, source), seen, F.col("device_id") % VIEWERS, looks, found, aspect=ASPECT)
    stream.option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    held = sinks.read_batches(spark, found, "view string, poi_id bigint, text string, nth int, u double, v double, sx double, sy double, shown boolean", numbered=True)
    return jobs.labels_of(sinks.read_batches(spark, looks, "event_id bigint, view string", numbered=True), _rounded(held, "u", "v", "sx", "sy"))


@query
def relief_map(fx):
    return jobs.relief_map(fx("vp"), blocks(fx), VIEW)


@query
def relief_markers(fx):
    return jobs.relief_markers(fx("vp"), jobs.clean_landmarks(fx("poi")), blocks(fx), VIEW)
