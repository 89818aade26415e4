"""Column expressions on the global arc-second grid (3600 steps a degree) and on windows of it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, TILE, TILES = 3600, 1024, 4
#: Pixels of a block's side: it divides a cell, and the sides of the files' tiles, which their format holds to multiples of 16.
BLOCK = 16
#: Metres of an arc-second of latitude, and of longitude at the latitude the maps are drawn for.
DELTA_Y = 40000 / 360 / 3600 * 1000
REF_LAT = 44.0


def delta_x(ref_lat: float = REF_LAT) -> float:
    return DELTA_Y * math.cos(math.radians(ref_lat))


def arc(degrees: Column) -> Column:
    """Whole arc-seconds, cut toward zero."""
    return (degrees * STEPS).cast("int")


def floor_div(x: Column, n: int) -> Column:
    """Floor of x / n, right for negative x too."""
    return F.floor(x / n).cast("int")


def window_range(lat: Column, lon: Column, size: int) -> dict[str, Column]:
    """Smallest and largest indices of the size x size window round a position, and the cells it touches."""
    lo_lat, lo_lon = arc(lat) - size // 2, arc(lon) - size // 2
    out = {"min_lat": lo_lat, "max_lat": lo_lat + (size - 1), "min_lon": lo_lon, "max_lon": lo_lon + (size - 1)}
    return out | {"cell_" + k: floor_div(v, STEPS) for k, v in out.items()}


def in_range(lat: Column, lon: Column, size: int, cells: tuple[int, int, int, int] = (43, 46, 5, 9), compat: bool = False) -> Column:
    """Whether the window lies in cells (lowest and highest latitude, lowest and highest longitude).

    compat: the upper sides are measured from the lowest cells' degrees, as if these were arc-seconds, so they hardly
    ever reject.
    """
    w = window_range(lat, lon, size)
    low_lat, high_lat, low_lon, high_lon = cells
    top_lat = F.lit(math.floor((low_lat + size - 1) / STEPS)) if compat else w["cell_max_lat"]
    top_lon = F.lit(math.floor((low_lon + size - 1) / STEPS)) if compat else w["cell_max_lon"]
    return (w["cell_min_lat"] >= low_lat) & (top_lat <= high_lat) & (w["cell_min_lon"] >= low_lon) & (top_lon <= high_lon)


def landmark_pixel(lat: Column, lon: Column, vp_lat: Column, vp_lon: Column, size: int, variant: str = "web") -> tuple[Column, Column]:
    """Column and row of a landmark in a viewpoint's window: rounded (web) or cut (sdl)."""
    d, half = (size // 2 - 1) / STEPS, 0.5 if variant == "web" else 0.0
    return ((lon - (vp_lon - d)) * STEPS + half).cast("int"), (((vp_lat + d) - lat) * STEPS + half).cast("int")


def pixel_address(ilat: Column, ilon: Column) -> dict[str, Column]:
    """Cell, tile and place in the tile of a pixel, and the tile's box in degrees."""
    cell_lat, cell_lon = floor_div(ilat, STEPS), floor_div(ilon, STEPS)
    r, c = (cell_lat + 1) * STEPS - 1 - ilat, ilon - cell_lon * STEPS
    ty, tx = floor_div(r, TILE), floor_div(c, TILE)
    side = TILE / STEPS
    return {
        "cell_lat": cell_lat, "cell_lon": cell_lon, "tile_x": tx, "tile_y": ty, "tile_index": tx + ty * TILES, "row": r - ty * TILE, "col": c - tx * TILE,
        "box_lat": cell_lat + 1 - (ty + 1) * side, "box_lon": cell_lon + tx * side, "box_lat_hi": cell_lat + 1 - ty * side, "box_lon_hi": cell_lon + (tx + 1) * side,
    }


def viewer_pixel(lat: Column, lon: Column, size: int, variant: str) -> tuple[Column, Column]:
    """(ilat, ilon) where the viewer stands: the window's middle (web, sdl), or the position's own pixel (exact)."""
    if variant == "exact":
        return arc(lat), arc(lon)
    w = window_range(lat, lon, size)
    return w["max_lat"] - size // 2, w["min_lon"] + size // 2
