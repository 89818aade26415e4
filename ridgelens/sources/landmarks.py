"""Landmarks from GeoJSON and from tables of map nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOJSON = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([T.StructField("name", T.StringType()), T.StructField("name:fr", T.StringType()), T.StructField("ele", T.StringType())])),
        T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    ]))),
])


def elevation(ele: Column) -> Column:
    """Whole metres, half up; null where the text is no number or no int holds it."""
    return F.try_add(ele.try_cast("double"), F.lit(0.5)).try_cast("int")


def parse_geojson(docs: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, ord, name, lat, lon, elevation, bad_elevation) from documents of features, with their place as ord.

    The French name wins over the name; features with neither, or without exactly two coordinates, are left out.
    """
    f = docs.select(*keep, F.from_json(json, GEOJSON).alias("d")).select(*keep, F.posexplode("d.features").alias("ord", "f"))
    at, ele = F.col("f.geometry.coordinates"), F.col("f.properties.ele")
    out = f.select(*keep, "ord", F.coalesce(F.col("f.properties.`name:fr`"), F.col("f.properties.name")).alias("name"), F.get(at, 1).alias("lat"), F.get(at, 0).alias("lon"), elevation(ele).alias("elevation"), (ele.isNotNull() & elevation(ele).isNull()).alias("bad_elevation"), F.size(at).alias("n"))
    return out.where(F.col("name").isNotNull() & (F.col("n") == 2)).drop("n")


def rejected_geojson(docs: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, ord, reason) of what parse_geojson() leaves out: documents that are no JSON of this kind (ord null), features without a name, or without two coordinates."""
    marked = T.StructType([*GEOJSON.fields, T.StructField("__corrupt", T.StringType())])
    d = docs.select(*keep, F.from_json(json, marked, {"columnNameOfCorruptRecord": "__corrupt"}).alias("d"))
    broken = F.col("d").isNull() | F.col("d.__corrupt").isNotNull() | F.col("d.features").isNull()
    whole = F.struct(F.lit(None).cast("int").alias("ord"), F.lit("no document of features").alias("reason"))
    named = lambda f: f["properties"]["name:fr"].isNotNull() | f["properties"]["name"].isNotNull()
    two = lambda f: F.coalesce(F.size(f["geometry"]["coordinates"]) == 2, F.lit(False))
    each = F.transform("d.features", lambda f, i: F.struct(i.alias("ord"), F.when(~named(f), "no name").when(~two(f), "not two coordinates").alias("reason")))
    out = d.select(*keep, F.explode(F.when(broken, F.array(whole)).otherwise(each)).alias("x")).select(*keep, "x.*")
    return out.where(F.col("reason").isNotNull())


def read_geojson_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(landmarks, rejects) of files with a feature on each line, which split over tasks where one large document does not.

    ord: the line's own id, rising in a file.  Both as parse_geojson() and rejected_geojson() tell them, with the file's name as `file`.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("json"))
    keep = ("file", "line")
    return parse_geojson(lines, keep=keep).drop("ord").withColumnRenamed("line", "ord"), rejected_geojson(lines, keep=keep).drop("ord").withColumnRenamed("line", "ord")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return parse_geojson(spark.read.text(path, wholetext=True), "value")


def extract_landmarks(nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Peaks and saddles among nodes (node_id, lat, lon, tags map) in a box (south, west, north, east), sides included."""
    south, west, north, east = box
    tag = F.col("tags")
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return nodes.where(tag["natural"].isin("peak", "saddle") & inside).select("node_id", tag["name"].alias("name"), tag["name:fr"].alias("name_fr"), tag["natural"].alias("natural"), "lat", "lon", tag["ele"].alias("ele"))


#: Named viewpoints (latitude, longitude, heading); the first is the default.
PRESETS = [
    ("La Chalannette", 44.3950846, 6.7669714, 170.0), ("Paris", 48.849418, 2.3674101, 0.0), ("Col Girardin", 44.607649, 6.8204019, 220.0), ("Col du Blainon", 44.209067, 6.9423065, 0.0), ("Auron", 44.207447, 6.9064, 40.0), ("Point 6", 44.278358, 6.790589, 0.0),
    ("Vallon de la Braissa", 44.280097, 6.793942, 0.0), ("Lacs de Morgon", 44.336025, 6.907772, 0.0), ("Roc Diolon", 44.73365, 6.3630684, 0.0), ("Col Fromage", 44.6896583, 6.8061028, 180.0), ("Point 11", 44.789628, 6.6702, 66.0),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PRESETS)], "preset int, name string, lat double, lon double, heading double")
