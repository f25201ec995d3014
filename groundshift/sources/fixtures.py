"""Raster, scene, grid and label tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import raster

SIDE = 40
PIXELS = SIDE * SIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pixel observation, bands side by side as 32-bit floats."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    pid, year = key % PIXELS, F.year("l_shipdate")
    burnt = (year > 1998) & (pid * 11 % 17 < 5)
    bands = {
        "b02": F.lit(0.02) + F.col("l_tax"),
        "b03": F.lit(0.01) + F.col("l_discount") + F.lit(0.04) * (pid * 5 % 7),
        "b04": F.lit(0.02) + F.col("l_discount"),
        "b08": F.col("l_quantity") * 0.008 * (F.lit(0.2) + (pid * 7 % 13) / F.lit(8.0)) * F.when(burnt, 0.3).otherwise(1.0),
        "b11": F.lit(0.05) + (pid * 3 % 11) * 0.03,
        "b12": line * 0.05,
    }
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", key, line).alias("scene_id"),
        F.col("l_shipdate").alias("ts"),
        F.when(year < 1998, "t1").when(year > 1998, "t2").alias("epoch"),
        F.floor(pid / SIDE).cast("int").alias("row"),
        (key % SIDE).cast("int").alias("col"),
        ((F.floor(key / PIXELS) * 5 + line * 3) % 12).cast("int").alias("scl"),
        *[v.cast("float").alias(b) for b, v in bands.items()],
    )


def spine(spark: SparkSession) -> DataFrame:
    """Every pixel of the grid."""
    return spark.range(PIXELS).select(F.floor(F.col("id") / SIDE).cast("int").alias("row"), (F.col("id") % SIDE).cast("int").alias("col"))


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.median_composite(raster.mask_stack(px_obs(spark, sf_dir)).filter("epoch is not null"))


def lulc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, row, col, class_id for all pixels of both epochs; 0 where nothing was seen."""
    seen = raster.classify(raster.indices(composite(spark, sf_dir))).select("epoch", "row", "col", "class_id")
    frame = spine(spark).select(F.explode(F.array(F.lit("t1"), F.lit("t2"))).alias("epoch"), "row", "col")
    return frame.join(seen, ["epoch", "row", "col"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def class_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, c1, c2: both epochs' classes of each pixel, from one shuffle of the composites."""
    return (
        lulc(spark, sf_dir).groupBy("row", "col")
        .agg(F.max(F.when(F.col("epoch") == "t1", F.col("class_id"))).alias("c1"), F.max(F.when(F.col("epoch") == "t2", F.col("class_id"))).alias("c2"))
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes_of(table(spark, sf_dir, "orders"))


def scenes_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    unit = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (key % 3 + 1).cast("int"))
    tile = F.element_at(F.array(F.lit("44RKU"), F.lit("44RLU"), F.lit("43RGP"), F.lit("43RGQ")), (F.col("o_custkey") % 4 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    keyless = key % 97 == 0
    baseline = F.element_at(F.array(F.lit("05.11"), F.lit("05.00"), F.lit("02.12"), F.lit("00.01"), F.lit("n/a")), F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.select(
        F.when(keyless, F.concat(F.lit("S2"), unit, F.lit("_"), day, F.lit("_"), key)).otherwise(F.concat(F.lit("S2"), unit, F.lit("_"), tile, F.lit("_"), day, F.lit("_"), key)).alias("id"),
        F.concat(F.lit("sentinel-2"), F.lower(unit)).alias("platform"),
        F.when(~keyless & (key % 5 != 0), tile).alias("mgrs"),
        F.col("o_orderdate").alias("datetime"),
        baseline.alias("baseline"),
        (F.col("o_totalprice") % 100).alias("cloud"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("boa_flag"),
        (F.col("o_orderstatus") != "P").alias("boa_present"),
        F.when(key % 2 == 0, -0.1).otherwise(0.0).alias("offset"),
    )


def dem(spark: SparkSession) -> DataFrame:
    r, c = F.col("row"), F.col("col")
    return spine(spark).withColumn("elevation", F.lit(500.0) + F.sin(r / F.lit(5.0)) * 10 + c * 3 + (r * c % 7))


def labels_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh pixel with the classes of two labellers, pixel centres on a 500 m grid."""
    pid = F.col("row") * SIDE + F.col("col")
    return class_pair(spark, sf_dir).filter(pid % 7 == 0).select(
        pid.alias("id"), "row", "col", ((F.col("col") + 0.5) * 500).alias("x"), ((F.col("row") + 0.5) * 500).alias("y"),
        F.col("c2").alias("class_a"), F.when(pid % 11 == 0, F.col("c2") % 5 + 1).otherwise(F.col("c2")).alias("class_b"),
    )


def external(spark: SparkSession) -> DataFrame:
    pid = F.col("row") * SIDE + F.col("col")
    return spine(spark).select("row", "col", (pid * 13 % 10 < 4).alias("built"), (pid % 26).alias("lossyear"), (pid * 17 % 101).alias("treecover"), (pid % 9 != 0).alias("datamask"))
