"""The two reports: labels of a panorama, and shaded relief with markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ridgelens.functions.grid import landmark_pixel, viewer_pixel, window_range
from ridgelens.operators import labels, raster, sight
from ridgelens.sources import sinks
from ridgelens.streaming import pose


def clean_landmarks(poi: DataFrame) -> DataFrame:
    """(poi_id, ord, name, elevation, lat, lon) of landmarks with a name, the French one first."""
    from ridgelens.sources.landmarks import elevation

    return poi.select("poi_id", "ord", F.coalesce("name_fr", "name").alias("name"), elevation(F.col("ele")).alias("elevation"), "lat", "lon").where(F.col("name").isNotNull())


def pairs_in_view(viewpoints: DataFrame, landmarks: DataFrame, size: int, variant: str = "web", blocks: DataFrame | None = None) -> DataFrame:
    """Pairs in view with the pixels of both: vlat, vlon (viewer), plat, plon (landmark) on the global grid; with blocks, also the heights vh, ph there.

    web and sdl place the viewer in the middle of the window and the landmark by its distance from the window's edge;
    exact cuts both positions to their own pixels.  Heights are looked up before pairs are made: once for each
    viewpoint, and once for each landmark with the pixels around it, of which each view takes its own.
    """
    v = viewpoints.select("vp_id", F.col("lat").alias("vp_lat"), F.col("lon").alias("vp_lon"), "heading")
    v = v.withColumns(dict(zip(("vlat", "vlon"), viewer_pixel(F.col("vp_lat"), F.col("vp_lon"), size, variant), strict=True)))
    if blocks is not None:
        v, landmarks = raster.sample_heights(v, blocks, "vlat", "vlon", "vh"), raster.heights_around(landmarks, blocks, "__around")
    near = sight.in_view(v, landmarks, size)
    if variant == "exact":
        place = viewer_pixel(F.col("lat"), F.col("lon"), size, "exact")
    else:
        x, y = landmark_pixel(F.col("lat"), F.col("lon"), F.col("vp_lat"), F.col("vp_lon"), size, variant)
        w = window_range(F.col("vp_lat"), F.col("vp_lon"), size)
        place = (w["max_lat"] - y, w["min_lon"] + x)
    out = near.withColumns({"plat": place[0], "plon": place[1]})
    return out if blocks is None else out.withColumn("ph", raster.pick_height("__around", "plat", "plon")).drop("__around")


def panorama_labels(viewpoints: DataFrame, landmarks: DataFrame, blocks: DataFrame, *, size: int, variant: str = "web", aspect: float = 4 / 3) -> DataFrame:
    """Visible, ranked, projected and thinned labels of each viewpoint, looking along its heading, upright.

    (vp_id, poi_id, text, nth, u, v, sx, sy, shown).  variant sdl: the level camera's ranking, and thinned labels are
    left out.
    """
    place = "sdl" if variant == "sdl" else "web"
    pairs = sight.visible_landmarks(pairs_in_view(viewpoints, landmarks, size, place, blocks), blocks)
    if variant == "sdl":
        seen = labels.ranked(labels.project_yaw(pairs), "v")
    else:
        posed = labels.ranked(pairs, labels.prominence()).withColumns({"alpha": F.col("heading"), "beta": F.lit(90.0), "gamma": F.lit(0.0), "screen": F.lit(0.0)})
        seen = labels.project(posed)
    out = labels.on_screen(labels.thin(seen, variant=variant), F.lit(aspect))
    return out.select("vp_id", "poi_id", labels.label_text(F.col("name"), F.col("elevation")).alias("text"), "nth", "u", "v", "sx", "sy", "shown")


def seen_from(viewpoints: DataFrame, landmarks: DataFrame, blocks: DataFrame, *, size: int) -> DataFrame:
    """Visible, ranked landmarks of viewpoints that stay where they are, for device_labels() and view_labels()."""
    pairs = sight.visible_landmarks(pairs_in_view(viewpoints, landmarks, size, "web", blocks), blocks)
    return labels.ranked(pairs, labels.prominence())


def device_labels(samples: DataFrame, seen: DataFrame, *, aspect: float = 4 / 3) -> DataFrame:
    """Projected and thinned labels of each orientation sample (device_id, ts, event_id, ANGLES).

    seen: what seen_from() gives, with the device_id of each viewpoint.  (vp_id, device_id, ts, event_id, poi_id, text, nth,
    u, v, sx, sy, shown); each sample is a view of its own.
    """
    return _drawn(samples.select("device_id", "ts", "event_id", *pose.ANGLES).join(seen, "device_id"), ("vp_id", "device_id", "ts", "event_id"), aspect)


def _drawn(turned: DataFrame, keys: tuple[str, ...], aspect: float) -> DataFrame:
    """Labels of views, told apart by keys, whose landmarks have the view's angles; only what is returned goes through the thinning."""
    text = labels.label_text(F.col("name"), F.col("elevation")).alias("text")
    placed = labels.project(turned).select(*keys, "poi_id", text, "nth", "u", "v", "inclination")
    return labels.on_screen(labels.thin(placed, keys=keys), F.lit(aspect)).select(*keys, "poi_id", "text", "nth", "u", "v", "sx", "sy", "shown")


def with_view(samples: DataFrame, stand: Column) -> DataFrame:
    """samples with the viewpoint (vp_id) where their device stands, and view: the viewpoint and the angles, told apart to the last bit.

    Samples of one view have the same labels.
    """
    angles = [F.coalesce(F.col(a).cast("string"), F.lit("null")) for a in pose.ANGLES]
    return samples.withColumn("vp_id", stand).withColumn("view", F.concat_ws(" ", F.col("vp_id").cast("string"), *angles))


def view_labels(samples: DataFrame, seen: DataFrame, *, aspect: float = 4 / 3) -> DataFrame:
    """Projected and thinned labels of each view of samples (view, vp_id, ANGLES), once however many samples have it.

    seen: what seen_from() gives.  (view, poi_id, text, nth, u, v, sx, sy, shown); labels_of() brings them to the samples.
    """
    views = samples.where("vp_id is not null").groupBy("view", "vp_id").agg(*[F.first(a).alias(a) for a in pose.ANGLES])
    return _drawn(views.join(seen, "vp_id"), ("view",), aspect)


def labels_of(samples: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, poi_id, text, nth, u, v, sx, sy, shown): the labels of each sample (event_id, view), from those of its view in its batch."""
    return samples.select("event_id", "view", sinks.BATCH).join(found, [sinks.BATCH, "view"]).select("event_id", "poi_id", "text", "nth", "u", "v", "sx", "sy", "shown")


def relabel(samples: DataFrame, seen: DataFrame, sink: Callable[[DataFrame, int], None], *, aspect: float = 4 / 3) -> DataStreamWriter:
    """A stream writer that hands sink the device_labels() of each sample of a stream that changes its device's pose."""
    return pose.changes_stream(samples).writeStream.foreachBatch(lambda changed, n: sink(device_labels(changed, seen, aspect=aspect), n))


def relabel_views(samples: DataFrame, seen: DataFrame, stand: Column, looks: str, found: str, *, aspect: float = 4 / 3) -> DataStreamWriter:
    """relabel() where labels are kept once for each view of a batch: what is written grows with samples and views, not with the labels of each sample.

    stand: the vp_id where a sample's device stands.  Batches of samples that change their device's pose go below looks,
    as with_view() gives them, the labels of their views below found; labels_of() puts both together.
    """

    def sink(changed: DataFrame, n: int) -> None:
        posed = with_view(changed, stand)
        sinks.write_batch(posed, looks, n)
        held = sinks.read_batches(posed.sparkSession, looks, pose.ORIENTATION + ", vp_id bigint, view string", n)  # else the state's work is done again
        sinks.write_labels(view_labels(held, seen, aspect=aspect), found, n)

    return pose.changes_stream(samples).writeStream.foreachBatch(sink)


def relief_map(viewpoints: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(vp_id, px, py, grey): each viewpoint's window, shaded and drawn at half size, py counted from the south.

    The raster's slopes are worked out once, however many windows share them; the window's rim lacks a neighbour.
    """
    slopes = raster.cut_windows(viewpoints, raster.slope_blocks(blocks), size, "slopes", 1).select("vp_id", "row", "col", "x.gx", "x.gy")
    return raster.halved(raster.hillshade_nw(slopes), "grey", size)


def relief_markers(viewpoints: DataFrame, landmarks: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(vp_id, poi_id, name, px, py, h): landmarks on the half-size map, with the height at their pixel."""
    at = pairs_in_view(viewpoints, landmarks, size, "sdl", blocks).withColumnRenamed("ph", "h")
    w = window_range(F.col("vp_lat"), F.col("vp_lon"), size)
    return at.select("vp_id", "poi_id", "name", F.floor((F.col("plon") - w["min_lon"]) / 2).cast("int").alias("px"), F.floor((F.col("plat") - w["min_lat"]) / 2).cast("int").alias("py"), "h")
