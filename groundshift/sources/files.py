"""File sources and sinks: scene items, boundaries, labels, candidates, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import raster, scenes, vector

ITEMS = "id string, properties struct<datetime:string,start_datetime:string,platform:string,`eo:cloud_cover`:double,`s2:mgrs_tile`:string,`s2:processing_baseline`:string,`sat:relative_orbit`:string,`earthsearch:boa_offset_applied`:boolean>, assets map<string,struct<href:string,`raster:bands`:array<struct<scale:double,offset:double>>>>, bbox array<double>"
LABELS = "id string, lon double, lat double, candidate_epoch string, class_t1 int, class_t2 int, labeller string, confidence string, notes string"
REQUIRED_LABELS = ("id", "lon", "lat", "class_t1", "class_t2", "labeller")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Cached scene items as the scenes table: id, platform, mgrs, datetime, baseline, cloud, flag, bbox, assets."""
    raw = spark.read.schema(ITEMS).option("multiLine", True).json(path)
    p = lambda name: F.col(f"properties.`{name}`")
    return raw.select(
        "id", p("platform").alias("platform"), p("s2:mgrs_tile").alias("mgrs"), F.try_to_timestamp(F.coalesce(p("datetime"), p("start_datetime"))).alias("datetime"), p("s2:processing_baseline").alias("baseline"),
        p("eo:cloud_cover").alias("cloud"), F.coalesce(p("sat:relative_orbit"), F.lit("unknown")).alias("relative_orbit"), p("earthsearch:boa_offset_applied").alias("boa_flag"), p("earthsearch:boa_offset_applied").isNotNull().alias("boa_present"), "bbox", "assets",
    )


def search_items(items: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, most_cloud: float | None = None, cap: int = 500) -> DataFrame:
    """Items whose box meets the query's and whose day is in range, deduplicated; filters reach the scan."""
    w, s, e, n = bbox
    b = F.col("bbox")
    hit = items.filter((b[0] <= e) & (b[2] >= w) & (b[1] <= n) & (b[3] >= s) & F.to_date("datetime").between(start, end))
    if most_cloud is not None:
        hit = hit.filter(F.col("cloud") <= most_cloud)
    kept = scenes.deduplicated(hit).select("id")
    return hit.join(kept, "id", "left_semi").orderBy("datetime", "id").limit(cap)


def band_coefficients(items: DataFrame, band: str) -> DataFrame:
    """scene_id, scale and effective offset of a band."""
    declared = F.try_element_at(F.try_element_at("assets", F.lit(band))["raster:bands"], F.lit(1))
    day = F.date_format("datetime", "yyyy-MM-dd")
    offset = raster.reflectance_offset(declared["offset"], F.col("baseline"), day, F.col("boa_present"), F.col("boa_flag"))
    return items.select(F.col("id").alias("scene_id"), F.coalesce(declared["scale"], F.lit(0.0001)).alias("scale"), offset.alias("offset"))


def write_items(items: DataFrame, path: str, provider: str, epoch: str) -> None:
    """Items as JSON and their metadata as CSV, in folders of provider and epoch."""
    tagged = items.withColumns({"provider": F.lit(provider), "epoch": F.lit(epoch)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "epoch").json(f"{path}/items")
    scenes.metadata(items).withColumns({"provider": F.lit(provider), "epoch": F.lit(epoch)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "epoch").option("header", True).csv(f"{path}/metadata")


def cached(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The table at path if it is there, else make() written there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if refresh or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file: properties as JSON text, geometry type, outer ring or line."""
    schema = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pair = lambda v: F.transform(v, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    polygon, line, point = F.from_json(text, "array<array<array<double>>>"), F.from_json(text, "array<array<double>>"), F.from_json(text, "array<double>")
    geom = F.when(kind == "Polygon", pair(polygon[0])).when(kind == "LineString", pair(line)).when(kind == "Point", pair(F.array(point)))
    return f.select("feature_id", F.col("f.properties").alias("properties"), kind.alias("kind"), geom.alias("ring"))


def bbox_layer(spark: SparkSession, bbox: tuple[float, float, float, float]) -> DataFrame:
    return spark.range(1).select(F.lit(4326).alias("srid"), vector.box_ring(*[F.lit(float(v)) for v in bbox]).alias("ring"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reference labels; an error names the required columns that the file lacks."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(REQUIRED_LABELS) - set(header))
    if missing:
        raise ValueError(f"label file lacks columns: {missing}")
    types = dict(f.strip().split(" ") for f in LABELS.split(","))
    return spark.read.option("header", True).csv(path).select(*[F.expr(f"try_cast({c} as {types[c]})").alias(c) for c in types if c in header])


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidate points, and a label file that has only its header."""
    candidates.write.mode("overwrite").parquet(f"{path}/candidates")
    candidates.sparkSession.createDataFrame([], LABELS).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/labels")


def write_composite(composite: DataFrame, path: str, chunk: int = 256) -> DataFrame:
    """A composite as Parquet by epoch and chunk; returns the statistics of what was written."""
    cut = lambda c: F.floor(F.col(c) / chunk).cast("int")
    keyed = composite.withColumn("chunk", F.format_string("r%05d_c%05d", cut("row"), cut("col")))
    keyed.repartition("epoch", "chunk").write.mode("overwrite").partitionBy("epoch", "chunk").parquet(path)
    return raster.band_stats(composite.sparkSession.read.parquet(path))


def mosaic(tiles: list[DataFrame], value: str) -> DataFrame:
    """One raster from overlapping tiles; the first tile with a value wins."""
    numbered = tiles[0].withColumn("_tile", F.lit(0))
    for i, t in enumerate(tiles[1:], 1):
        numbered = numbered.unionByName(t.withColumn("_tile", F.lit(i)))
    return numbered.filter(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min_by(value, "_tile").alias(value))
