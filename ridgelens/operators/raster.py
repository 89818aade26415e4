"""Raster operators on blocks of BLOCK x BLOCK pixels: (bi, bj, h), and (cell_lat, cell_lon) where ingest wrote them.

bi, bj are the global indices over BLOCK; h holds heights by row from the south-west, null where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelens.functions.grid import BLOCK, DELTA_Y, REF_LAT, STEPS, delta_x, floor_div, window_range


def to_blocks(dem: DataFrame, side: int = BLOCK) -> DataFrame:
    """Blocks of the logical table dem (ilat, ilon, h), which has one row for each pixel: one shuffle of the raster.

    Of pixels that stand twice, the lower one counts.  A block that is not full is filled in one pass over its pixels:
    each brings the nulls between it and the next one.
    """
    k = ((F.col("ilat") - F.col("bi") * side) * side + F.col("ilon") - F.col("bj") * side).cast("int")
    dem = dem.withColumn("bi", floor_div(F.col("ilat"), side)).withColumn("bj", floor_div(F.col("ilon"), side))
    px = dem.groupBy("bi", "bj").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), F.col("h").cast("double").alias("h")))).alias("px"))
    full = (F.size("px") == side * side) & (F.size(F.array_distinct("px.k")) == side * side)
    none, at = F.lit(None).cast("double"), F.col("px.k")
    nulls = lambda n: F.array_repeat(none, F.greatest(n, F.lit(0)).cast("int"))

    def with_gap(x: Column, i: Column) -> Column:
        again = (i > 0) & (F.get(at, i - 1) == x["k"])
        gap = nulls(F.coalesce(F.get(at, i + 1), F.lit(side * side)) - x["k"] - 1)
        return F.when(again, gap).otherwise(F.concat(F.array(x["h"]), gap))

    filled = F.concat(nulls(F.get(at, F.lit(0))), F.flatten(F.transform("px", with_gap)))
    return px.select("bi", "bj", F.when(full, F.col("px.h")).otherwise(filled).alias("h"))


def place(ilat: Column, ilon: Column, side: int = BLOCK) -> tuple[Column, Column, Column]:
    """Block and place in the block of a pixel."""
    bi, bj = floor_div(ilat, side), floor_div(ilon, side)
    return bi, bj, ((ilat - bi * side) * side + ilon - bj * side).cast("int")


def sample_heights(points: DataFrame, blocks: DataFrame, ilat: str = "ilat", ilon: str = "ilon", out: str = "h", side: int = BLOCK) -> DataFrame:
    """points with the height at their pixel, null off the raster."""
    bi, bj, at = place(F.col(ilat), F.col(ilon), side)
    met = points.withColumns({"__bi": bi, "__bj": bj}).join(blocks.select(F.col("bi").alias("__bi"), F.col("bj").alias("__bj"), F.col("h").alias("__h")), ["__bi", "__bj"], "left")
    return met.withColumn(out, F.get("__h", at).cast("double")).drop("__bi", "__bj", "__h")


#: Pixels of a point's surroundings: a landmark's pixel in a view lies from one before to two behind its own, for any rounding and sign.
AROUND = range(-1, 3)


def heights_around(points: DataFrame, blocks: DataFrame, out: str = "around", side: int = BLOCK) -> DataFrame:
    """points (poi_id, lat, lon, ...) with the heights of the AROUND x AROUND pixels at floor(lat * 3600), floor(lon * 3600), for pick_height().

    Each point is looked up once, however many views see it, in the four blocks at most that its surroundings touch.
    Points without coordinates get null.
    """
    n, low = len(AROUND), AROUND[0]
    p = points.where("lat is not null and lon is not null").select("poi_id", "lat", "lon").distinct()
    p = p.selectExpr("*", f"cast(floor(lat * {STEPS}) as int) + {low} as __i", f"cast(floor(lon * {STEPS}) as int) + {low} as __j")
    touched = lambda c: f"explode(array_distinct(array(cast(floor({c} / {side}) as int), cast(floor(({c} + {n - 1}) / {side}) as int))))"
    p = p.withColumn("__bi", F.expr(touched("__i"))).withColumn("__bj", F.expr(touched("__j")))
    met = p.join(blocks.selectExpr("bi as __bi", "bj as __bj", "h"), ["__bi", "__bj"]).selectExpr("poi_id", "lat", "lon", "h", f"__i - __bi * {side} as i", f"__j - __bj * {side} as j")
    own = [f"max(case when i + {a} between 0 and {side - 1} and j + {b} between 0 and {side - 1} then cast(get(h, (i + {a}) * {side} + j + {b}) as double) end)" for a in range(n) for b in range(n)]
    found = met.groupBy("poi_id", "lat", "lon").agg(F.expr(f"array({', '.join(own)})").alias(out))
    return points.join(found, ["poi_id", "lat", "lon"], "left")


def pick_height(around: str, ilat: str, ilon: str) -> Column:
    """The height at a pixel of a point's surroundings; null off them."""
    n = len(AROUND)
    i, j = (F.col(c) - F.floor(F.col(d) * STEPS).cast("int") - AROUND[0] for c, d in ((ilat, "lat"), (ilon, "lon")))
    return F.when(i.between(0, n - 1) & j.between(0, n - 1), F.get(around, (i * n + j).cast("int")))


def held_near(blocks: DataFrame, positions: DataFrame, size: int) -> DataFrame:
    """blocks in the latitudes that the positions' windows touch, by the table's partitions (band, or cell_lat), so that others are not read.

    The latitudes are worked out first and come to the driver: 180 whole numbers at most, however many positions there are.
    """
    by = "band" if "band" in blocks.columns else "cell_lat"
    w = window_range(F.col("lat"), F.col("lon"), size)
    found = positions.where("lat is not null and lon is not null").select(F.explode(F.sequence(w["cell_min_lat"], w["cell_max_lat"])).alias("c")).distinct().collect()
    return blocks.where(F.col(by).isin([r.c for r in found])) if found else blocks.where(F.lit(False))


def cut_windows(viewpoints: DataFrame, blocks: DataFrame, size: int, column: str = "h", edge: int = 0, side: int = BLOCK) -> DataFrame:
    """(vp_id, row, col, ilat, ilon, x): what an array of the blocks holds in each viewpoint's window, row 0 north.

    Missing entries are absent; edge: so many pixels at the window's rim are left out.  The window is exploded to the
    keys of the blocks it touches, and the join is on equal keys, cells included where the blocks have them.
    """
    w = window_range(F.col("lat"), F.col("lon"), size)
    v = viewpoints.select("vp_id", *[w[c].alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    v = v.withColumn("bi", F.explode(F.sequence(floor_div(F.col("min_lat"), side), floor_div(F.col("max_lat"), side)))).withColumn("bj", F.explode(F.sequence(floor_div(F.col("min_lon"), side), floor_div(F.col("max_lon"), side))))
    on = ["bi", "bj"]
    if "cell_lat" in blocks.columns:
        v, on = v.withColumns({"cell_lat": floor_div(F.col("bi") * side, STEPS), "cell_lon": floor_div(F.col("bj") * side, STEPS)}), ["cell_lat", "cell_lon", *on]
    p = v.join(blocks.select(*on, column), on).select("vp_id", "min_lat", "max_lat", "min_lon", "max_lon", "bi", "bj", F.posexplode(column).alias("k", "x")).where(F.col("x").isNotNull())
    p = p.withColumn("ilat", F.col("bi") * side + floor_div(F.col("k"), side)).withColumn("ilon", F.col("bj") * side + F.col("k") % side)
    p = p.where(F.col("ilat").between(F.col("min_lat") + edge, F.col("max_lat") - edge) & F.col("ilon").between(F.col("min_lon") + edge, F.col("max_lon") - edge))
    return p.select("vp_id", (F.col("max_lat") - F.col("ilat")).alias("row"), (F.col("ilon") - F.col("min_lon")).alias("col"), "ilat", "ilon", "x")


def window_mosaic(viewpoints: DataFrame, blocks: DataFrame, size: int, side: int = BLOCK) -> DataFrame:
    """(vp_id, row, col, ilat, ilon, h): each viewpoint's window cut from blocks, row 0 north; missing pixels are absent."""
    return cut_windows(viewpoints, blocks, size, side=side).withColumn("x", F.col("x").cast("double")).withColumnRenamed("x", "h")


def _bordered(blocks: DataFrame, side: int) -> DataFrame:
    """(bi, bj, h, n, s, e, w): blocks with their neighbours' next rows and columns, null where there is no neighbour.

    A block sends its outer rows and columns to its neighbours, so one shuffle moves each block and a quarter of it.
    """
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    west, east = F.transform(steps, lambda i: F.get("h", i * side)), F.transform(steps, lambda i: F.get("h", i * side + side - 1))
    parts = (("h", 0, 0, F.col("h")), ("n", -1, 0, F.slice("h", 1, side)), ("s", 1, 0, F.slice("h", side * (side - 1) + 1, side)), ("e", 0, -1, west), ("w", 0, 1, east))
    sent = blocks.select(F.explode(F.array(*[F.struct((F.col("bi") + i).alias("bi"), (F.col("bj") + j).alias("bj"), F.lit(name).alias("part"), v.alias("v")) for name, i, j, v in parts])).alias("x")).select("x.*")
    met = sent.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("m"))
    return met.select("bi", "bj", *[F.try_element_at("m", F.lit(name)).alias(name) for name in "hnsew"]).where(F.col("h").isNotNull())


def _slope(k: Column, side: int) -> Column:
    """(h, gx, gy) of a bordered block's k-th pixel; null but where it and its four neighbours exist."""
    row, col = floor_div(k, side), k % side
    get = lambda edge, rim, i, step: F.when(edge, F.get(rim, i)).otherwise(F.get("h", k + step)).cast("double")
    gx = get(col == 0, "w", row, -1) - get(col == side - 1, "e", row, 1)
    gy = get(row == side - 1, "n", col, side) - get(row == 0, "s", col, -side)
    own = F.get("h", k).cast("double")
    return F.when(own.isNotNull() & gx.isNotNull() & gy.isNotNull(), F.struct(own.alias("h"), gx.alias("gx"), gy.alias("gy")))


def slope_blocks(blocks: DataFrame, side: int = BLOCK) -> DataFrame:
    """blocks with slopes, an array of (h, gx, gy) in place of h: gx is west - east, gy north - south."""
    cell = {"cell_lat": floor_div(F.col("bi") * side, STEPS), "cell_lon": floor_div(F.col("bj") * side, STEPS)}
    slopes = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: _slope(k, side))
    return _bordered(blocks, side).select(*[c.alias(n) for n, c in cell.items() if n in blocks.columns], "bi", "bj", slopes.alias("slopes"))


def gradient(blocks: DataFrame, side: int = BLOCK, form: str = "columns") -> DataFrame:
    """(ilat, ilon, h, gx, gy) of the pixels that have four neighbours.

    form: columns works a pixel at a time in the JVM; arrow hands bordered blocks to numpy, KERNEL at a time.  Both give
    the same rows; blocks have side * side heights, some of them null.
    """
    if form == "arrow":
        wide = _bordered(blocks, side).select("bi", "bj", *[F.col(c).cast("array<double>").alias(c) for c in "hnsew"])
        return wide.mapInArrow(_kernel(side), "ilat int, ilon int, h double, gx double, gy double")
    p = _bordered(blocks, side).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).select("bi", "bj", "k", _slope(F.col("k"), side).alias("x")).where(F.col("x").isNotNull())
    return p.select((F.col("bi") * side + floor_div(F.col("k"), side)).alias("ilat"), (F.col("bj") * side + F.col("k") % side).alias("ilon"), "x.*")


#: Blocks that the kernel takes at a time: some 10 MB of slopes at 16 x 16 pixels.
KERNEL = 1024


def _values(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists' values as rows of `width`, and which of them are there; a null list is a row without any."""
    values, there = np.zeros((len(lists), width)), np.zeros((len(lists), width), bool)
    held, flat = lists.is_valid().to_numpy(zero_copy_only=False), lists.flatten()
    values[held] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    there[held] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    return values, there


def _kernel(side: int):
    """From batches of bordered blocks (bi, bj, h, n, s, e, w) to batches of (ilat, ilon, h, gx, gy)."""
    inner, low, high = slice(1, -1), slice(None, -2), slice(2, None)
    rims = (("h", inner, inner), ("n", -1, inner), ("s", 0, inner), ("e", inner, -1), ("w", inner, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KERNEL):
                part = batch.slice(at, KERNEL)
                n = part.num_rows
                h, there = np.zeros((n, side + 2, side + 2)), np.zeros((n, side + 2, side + 2), bool)
                for name, row, col in rims:
                    values, held = _values(part.column(name), side * side if name == "h" else side)
                    shape = h[:, row, col].shape
                    h[:, row, col], there[:, row, col] = values.reshape(shape), held.reshape(shape)
                gx, gy = h[:, inner, low] - h[:, inner, high], h[:, high, inner] - h[:, low, inner]
                full = there[:, inner, inner] & there[:, inner, low] & there[:, inner, high] & there[:, low, inner] & there[:, high, inner]
                b, i, j = np.nonzero(full)
                ilat, ilon = (part.column(c).to_numpy()[b] * side + k for c, k in (("bi", i), ("bj", j)))
                columns = [ilat.astype(np.int32), ilon.astype(np.int32), h[:, inner, inner][full], gx[full], gy[full]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ilat", "ilon", "h", "gx", "gy"])

    return run


def normals(slopes: DataFrame, ref_lat: float = REF_LAT) -> DataFrame:
    """slopes with nx, ny, nz: the surface normal at length 127, cut to bytes."""
    dx, dy = delta_x(ref_lat), DELTA_Y
    x, y, z = F.col("gx") * dy, F.col("gy") * dx, F.lit(2 * dx * dy)
    n = F.lit(127.0) / F.sqrt(x * x + y * y + z * z)
    return slopes.withColumns({"nx": (x * n).cast("tinyint"), "ny": (y * n).cast("tinyint"), "nz": (z * n).cast("tinyint")})


def hillshade_nw(slopes: DataFrame) -> DataFrame:
    """slopes with grey (0 to 255): light from (-1, -1, 1) on normals of 30 m pixels."""
    x, y, z = F.col("gx"), F.col("gy"), F.lit(60.0)
    light = F.greatest(F.lit(0.0), -(x + y - z) / F.sqrt(F.lit(3.0)) / F.sqrt(x * x + y * y + z * z))
    return slopes.withColumn("grey", (light * 255.9).cast("int"))


def hillshade_relief(slopes: DataFrame, ref_lat: float = REF_LAT) -> DataFrame:
    """slopes with light (0 to 1): (-1, 1, 2) / sqrt 6 on the unit normal; gy keeps its sign."""
    dx, dy = delta_x(ref_lat), DELTA_Y
    x, y, z = F.col("gx") * dy, F.col("gy") * dx, F.lit(2 * dx * dy)
    return slopes.withColumn("light", F.greatest(F.lit(0.0), (-x + y + 2 * z) / F.sqrt(x * x + y * y + z * z) / F.sqrt(F.lit(6.0))))


def pyramid_levels(width: int) -> int:
    """Levels of a pyramid over the next power of two."""
    return max(1, (width - 1).bit_length())


def gradient_pyramid(slopes: DataFrame, levels: int) -> DataFrame:
    """(level, row, col, gx, gy) of levels 1 to levels - 1: means of the existing pixels of 2**level squares, by global index.

    The higher levels add up the first one's sums and counts, so a level costs a quarter of the pixels.
    """
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    first = slopes.groupBy(half("ilat").alias("row"), half("ilon").alias("col")).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.count("*").alias("n"))
    each = first.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(max(1, levels - 1)))))
    side = F.expr("shiftleft(1, level - 1)")
    at = [F.floor(F.col(c) / side).cast("int").alias(c) for c in ("row", "col")]
    return each.groupBy("level", *at).agg((F.sum("gx") / F.sum("n")).alias("gx"), (F.sum("gy") / F.sum("n")).alias("gy"))


def halved(shaded: DataFrame, value: str, size: int, keys: tuple[str, ...] = ("vp_id",)) -> DataFrame:
    """Every second pixel of a window drawn from the south: of four that fall on one place, the last one drawn stays."""
    place = [(F.col("col") / 2).cast("int").alias("px"), ((F.lit(size - 1) - F.col("row")) / 2).cast("int").alias("py")]
    return shaded.groupBy(*keys, *place).agg(F.max_by(value, F.struct("row", "col")).alias(value))
