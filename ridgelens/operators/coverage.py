"""Which elevation cells a table of positions needs, and where each position's view starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelens.functions.grid import in_range, window_range
from ridgelens.sources.landmarks import PRESETS


def cell_requirement(positions: DataFrame, size: int) -> DataFrame:
    """Distinct (cell_lat, cell_lon) that the windows touch; positions without coordinates need none."""
    w = window_range(F.col("lat"), F.col("lon"), size)
    cells = positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.sequence(w["cell_min_lat"], w["cell_max_lat"]).alias("a"), F.sequence(w["cell_min_lon"], w["cell_max_lon"]).alias("b"))
    return cells.distinct().select(F.explode("a").alias("cell_lat"), "b").select("cell_lat", F.explode("b").alias("cell_lon")).distinct()


def coverage_gap(positions: DataFrame, held: DataFrame, size: int = 6144) -> DataFrame:
    """Required cells that are not held yet: what to fetch."""
    return cell_requirement(positions, size).join(held, ["cell_lat", "cell_lon"], "left_anti")


def resolve_viewpoints(positions: DataFrame, size: int, cells: tuple[int, int, int, int] = (43, 46, 5, 9), compat: bool = False) -> DataFrame:
    """positions with lat, lon, heading replaced: as measured (heading 0) where the window is covered, else the first preset."""
    own = F.coalesce(in_range(F.col("lat"), F.col("lon"), size, cells, compat), F.lit(False))
    _, lat, lon, heading = PRESETS[0]
    out = positions.withColumn("use_geoloc", own)
    return out.withColumns({"lat": F.when(F.col("use_geoloc"), F.col("lat")).otherwise(lat), "lon": F.when(F.col("use_geoloc"), F.col("lon")).otherwise(lon), "heading": F.when(F.col("use_geoloc"), 0.0).otherwise(heading)})
