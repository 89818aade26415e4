"""Elevation files: catalogue, and the job that turns them into a partitioned table of decoded blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ridgelens.functions.grid import BLOCK, STEPS

NAME = r"_([NS])(\d+)_\d+_([EW])(\d+)_\d+_DEM\.tif$"
BLOCK_SCHEMA = "cell_lat int, cell_lon int, bi int, bj int, h array<float>"

# fixed values: tags of the file's directory and what the contract asks of them
WIDTH, HEIGHT, BITS, PACKING, SAMPLES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS = 256, 257, 258, 259, 277, 317, 322, 323, 324, 325
ASKED = {BITS: 32, PACKING: 8, SAMPLES: 1, PREDICTOR: 3}
SHORT, LONG = 3, 4


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(cell_lat, cell_lon, path, length) of the files below path; contents are not read.  The cell of a name that tells none is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_DEM.tif").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select(*cell_of(F.col("path")), "path", "length")


def cell_of(path: Column) -> list[Column]:
    """cell_lat and cell_lon that a file's name tells, else null."""
    part = lambda k: F.regexp_extract(path, NAME, k)
    signed = lambda sign, minus, n: (F.when(part(sign) == minus, -1).otherwise(1) * part(n).try_cast("int")).cast("int")
    return [signed(1, "S", 2).alias("cell_lat"), signed(3, "W", 4).alias("cell_lon")]


def _directory(raw: bytes) -> dict[int, tuple[int, int, int]]:
    """Tag to (type, count, value or offset)."""
    if raw[:4] != b"II*\0":
        raise ValueError("not a little-endian file of this kind")
    (at,) = struct.unpack_from("<I", raw, 4)
    (n,) = struct.unpack_from("<H", raw, at)
    return {tag: (kind, count, value) for tag, kind, count, value in (struct.unpack_from("<HHII", raw, at + 2 + 12 * k) for k in range(n))}


def file_layout(raw: bytes, width: int = STEPS) -> dict:
    """Sizes and tile places of a file; ValueError where it breaks the contract."""
    d = _directory(raw)

    def short(tag: int) -> int:
        kind, count, value = d.get(tag, (0, 0, 0))
        if kind != SHORT or count != 1:
            raise ValueError(f"tag {tag} is not one short number")
        return value & 0xFFFF

    def longs(tag: int) -> list[int]:
        kind, count, at = d.get(tag, (0, 0, 0))
        if kind != LONG or count < 2:
            raise ValueError(f"tag {tag} is not a list of long numbers")
        return list(struct.unpack_from(f"<{count}I", raw, at))

    for tag, value in ASKED.items():
        if short(tag) != value:
            raise ValueError(f"tag {tag} is {short(tag)}, not {value}")
    out = {"width": short(WIDTH), "height": short(HEIGHT), "tile_width": short(TILE_WIDTH), "tile_height": short(TILE_HEIGHT), "offsets": longs(OFFSETS), "counts": longs(COUNTS)}
    if out["width"] != width or out["height"] != width:
        raise ValueError(f"{out['width']} x {out['height']} pixels, not {width} x {width}")
    if out["tile_width"] % BLOCK or out["tile_height"] % BLOCK or not out["tile_width"] or not out["tile_height"]:
        raise ValueError(f"tiles of {out['tile_width']} x {out['tile_height']} pixels, no multiples of {BLOCK}")
    return out


def decode_tile(packed: bytes, width: int, height: int) -> np.ndarray:
    """Heights of a tile: inflate, running sums of bytes along each row, then four byte planes, highest first."""
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    if raw.size != 4 * width * height:
        raise ValueError("a tile of the wrong length")
    planes = np.cumsum(raw.reshape(height, 4 * width), axis=1, dtype=np.uint8).reshape(height, 4, width)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4").reshape(height, width).astype(np.float32)


def encode_file(heights: np.ndarray, tile: int, *, magic: bytes = b"II*\0", tags: dict[int, int] | None = None) -> bytes:
    """A file of this format with a square of heights, row 0 north, in tiles of tile x tile pixels; the last ones are filled with -9."""
    side, packed = len(heights), []
    for r in range(0, side, tile):
        for c in range(0, side, tile):
            t = np.full((tile, tile), -9.0, np.float32)
            part = heights[r : r + tile, c : c + tile]
            t[: part.shape[0], : part.shape[1]] = part
            planes = t.astype(">f4").view(np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, 4 * tile)
            steps = planes.copy()
            steps[:, 1:] -= planes[:, :-1]
            packed.append(zlib.compress(steps.tobytes()))
    at = 8 + np.cumsum([0] + [len(t) for t in packed])
    lists, n = int(at[-1]), len(packed)
    numbers = {WIDTH: side, HEIGHT: side, TILE_WIDTH: tile, TILE_HEIGHT: tile} | ASKED | (tags or {})
    entries = [(k, SHORT, 1, v) for k, v in numbers.items()] + [(OFFSETS, LONG, n, lists), (COUNTS, LONG, n, lists + 4 * n)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
    return magic + struct.pack("<I", lists + 8 * n) + b"".join(packed) + struct.pack(f"<{n}I", *at[:-1]) + struct.pack(f"<{n}I", *map(len, packed)) + directory


def decode_files(files: DataFrame, *, width: int = STEPS) -> DataFrame:
    """(cell_lat, cell_lon, bi, bj, h, path, reason) of files (path, content): decoded blocks of raster's layout, or a row with the reason why a file or tile breaks the contract.

    A first pass cuts files into packed tiles, which are then dealt over all tasks by cell and tile and decoded there.
    Pixels of a last tile beyond the cell are left out: they belong to the neighbour.
    """
    if width % BLOCK:
        raise ValueError(f"a cell's width must be a multiple of {BLOCK}")
    files = files.select(*cell_of(F.col("path")), "path", "content")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lat, lon, name, raw in frame.itertuples(index=False):
                try:
                    if pd.isna(lat) or pd.isna(lon):
                        raise ValueError("the name tells no cell")
                    x = file_layout(raw, width)
                    rows += [(lat, lon, name, k, x["tile_width"], x["tile_height"], raw[a : a + n], None) for k, (a, n) in enumerate(zip(x["offsets"], x["counts"], strict=True))]
                except (ValueError, struct.error) as e:
                    rows.append((lat, lon, name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["cell_lat", "cell_lon", "path", "tile", "tw", "th", "packed", "reason"]).astype({c: "Int32" for c in ("cell_lat", "cell_lon", "tile", "tw", "th")})

    tiles = files.mapInPandas(cut, "cell_lat int, cell_lon int, path string, tile int, tw int, th int, packed binary, reason string")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lat, lon, name, k, tw, th, packed, reason in frame.itertuples(index=False):
                try:
                    if reason is not None:
                        raise ValueError(reason)
                    across = -(-width // int(tw))
                    top, left = int(k) // across * int(th), int(k) % across * int(tw)
                    h = decode_tile(packed, int(tw), int(th))[: width - top, : width - left]
                    south, west = STEPS * (lat + 1) - BLOCK - top, STEPS * lon + left
                    rows += [(lat, lon, (south - r) // BLOCK, (west + c) // BLOCK, h[r : r + BLOCK, c : c + BLOCK][::-1].ravel(), None, None) for r in range(0, h.shape[0], BLOCK) for c in range(0, h.shape[1], BLOCK)]
                except (ValueError, zlib.error) as e:
                    rows.append((lat, lon, None, None, None, name, str(e)))
            yield pd.DataFrame(rows, columns=["cell_lat", "cell_lon", "bi", "bj", "h", "path", "reason"]).astype({c: "Int32" for c in ("cell_lat", "cell_lon", "bi", "bj")})

    return tiles.repartition("cell_lat", "cell_lon", "tile").mapInPandas(decode, BLOCK_SCHEMA + ", path string, reason string")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*_DEM.tif").option("recursiveFileLookup", "true").load(paths)


def _write(decoded: DataFrame, out: str) -> None:
    """Decoded rows by cell below out; a cell that is written again is replaced, others stay."""
    ordered = decoded.withColumn("broken", F.col("reason").isNotNull()).repartition("cell_lat", "cell_lon").sortWithinPartitions("broken", "cell_lat", "cell_lon", "bi", "bj")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("broken", "cell_lat", "cell_lon").parquet(out)


def _held(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA + ", path string, reason string, broken boolean").parquet(out)


def ingest(spark: SparkSession, path: str, out: str, *, width: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) of all files below path, as decode_files() gives them, read back from the table at out.

    The table is written once, by cell, so that a window reads the cells it touches.
    """
    _write(decode_files(_files(spark, path), width=width), out)
    held = _held(spark, out)
    return held.where(~F.col("broken")).select("cell_lat", "cell_lon", "bi", "bj", "h"), held.where("broken").select("path", "reason").distinct()


LOG = "path string, length bigint, modified timestamp, cell_lat int, cell_lon int, reason string"


def refresh(spark: SparkSession, path: str, out: str, *, width: int = STEPS, needed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, files, how many files were decoded): brings the table at out up to date with the files below path.

    needed: cells (cell_lat, cell_lon), as coverage_gap() lists them; files of other cells wait until they are asked for.
    The log beside the table (LOG) tells which files it holds, by name, length and time.  Only files it does not tell of
    are opened and decoded, so a second run decodes nothing; a file that has changed replaces its cell, and one that is
    broken now leaves the cell as it was.  Blocks are written before the log, so a run that fails is made up for by the
    next.  The names of files to open come to the driver: one for each cell, 64,800 at most.
    """
    log = f"{out.rstrip('/')}.files"
    try:
        known = spark.read.schema(LOG).parquet(log)
    except AnalysisException:  # nothing is held yet
        known = spark.createDataFrame([], LOG)
    found = _files(spark, path).select("path", "length", F.col("modificationTime").alias("modified"), *cell_of(F.col("path")))
    new = found.join(known, ["path", "length", "modified"], "left_anti")
    if needed is not None:
        new = new.join(needed.select("cell_lat", "cell_lon").distinct(), ["cell_lat", "cell_lon"], "left_semi")
    rows = new.select("path", "length", "modified", "cell_lat", "cell_lon").collect()
    if rows:
        _write(decode_files(_files(spark, [r.path for r in rows]), width=width), out)
        why = _held(spark, out).where("broken").groupBy("path").agg(F.min("reason").alias("reason"))
        spark.createDataFrame(rows, LOG.rpartition(",")[0]).join(why, "path", "left").select(*[c.split()[0] for c in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(log)
    try:
        held = _held(spark, out)
    except AnalysisException:  # no file at all
        held = spark.createDataFrame([], BLOCK_SCHEMA + ", path string, reason string, broken boolean")
    return held.where(~F.col("broken")).select("cell_lat", "cell_lon", "bi", "bj", "h"), spark.read.schema(LOG).parquet(log) if rows else known, len(rows)


def pixels(blocks: DataFrame) -> DataFrame:
    """The logical table (ilat, ilon, h double) of blocks."""
    p = blocks.select("bi", "bj", F.posexplode("h").alias("k", "h")).where(F.col("h").isNotNull())
    return p.select((F.col("bi") * BLOCK + F.floor(F.col("k") / BLOCK)).cast("int").alias("ilat"), (F.col("bj") * BLOCK + F.col("k") % BLOCK).alias("ilon"), F.col("h").cast("double").alias("h"))
