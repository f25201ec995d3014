"""OpenStreetMap way files (Overpass JSON): query texts and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tag predicates of the three layers.
FILTERS = {"roads": '["highway"~"^(motorway|trunk|primary|secondary|tertiary|residential|unclassified)$"]', "rivers": '["waterway"~"^(river|stream|canal)$"]', "buildings": '["building"]'}
SCHEMA = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def bbox_text(west: float, south: float, east: float, north: float) -> str:
    """The order that the service wants: south, west, north, east."""
    return f"{south},{west},{north},{east}"


def query_text(layer: str, bbox: tuple[float, float, float, float], timeout_s: int = 60) -> str:
    return f"[out:json][timeout:{timeout_s}];way{FILTERS[layer]}({bbox_text(*bbox)});out geom;"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def ways(documents: DataFrame) -> DataFrame:
    """Ways of at least two points: id, name ('' if none), kind, geometry as array<struct<x,y>>, closed (a polygon)."""
    e = documents.select(F.explode("elements").alias("e")).filter((F.col("e.type") == "way") & (F.size("e.geometry") >= 2))
    tag = lambda k: F.nullif(F.try_element_at("e.tags", F.lit(k)), F.lit(""))
    geom = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    out = e.select(F.col("e.id").alias("osm_id"), F.coalesce(tag("name"), F.lit("")).alias("name"), F.coalesce(tag("highway"), tag("waterway"), tag("building")).alias("kind"), geom.alias("geom"))
    return out.withColumn("closed", (F.size("geom") >= 4) & (F.element_at("geom", 1) == F.element_at("geom", -1)))


def sample(spark: SparkSession) -> DataFrame:
    """A document with every case: too short, no geometry, other types, a closed ring."""
    p = lambda *xy: [(float(y), float(x)) for x, y in xy]
    rows = [("way", 1, {"highway": "primary", "name": "Main"}, p((0, 0), (1, 1))), ("way", 2, {"waterway": "river"}, p((0, 0), (1, 1), (2, 1))), ("way", 3, {"building": "yes"}, p((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))), ("way", 4, {"highway": "primary"}, p((0, 0))), ("node", 5, {}, None), ("way", 6, {"highway": "x"}, None)]
    return spark.createDataFrame([(rows,)], SCHEMA)
