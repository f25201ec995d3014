"""The SQL entry point: tables for areas, cells, results and manifests, and the spatial queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import vector

# The tables of the engine; geometry is a ring array with its SRID beside it, clustered by cell instead of a tree index.
DDL = {
    "aoi": "name string, srid int, ring array<struct<x:double,y:double>>, updated_at timestamp",
    "grid_cells": "cell_id int, row_idx int, col_idx int, srid int, ring array<struct<x:double,y:double>>, gain_ha double, loss_ha double, overlap_ha double, valid_frac double, gi_z double, gi_p double, is_hotspot boolean, run_id string, updated_at timestamp",
    "change_results": "run_id string, urban_gain_ha double, vegetation_loss_ha double, tree_to_built_ha double, overlap_pct double, updated_at timestamp",
    "run_manifest": "run_id string, created_at timestamp, config_hash string, params string, scene_ids string, stats string, timings string, results string",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in DDL.items():
        cluster = " CLUSTERED BY (cell_id) INTO 16 BUCKETS" if name == "grid_cells" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{cluster}")


def missing_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return [t for t in DDL if not spark.catalog.tableExists(f"{database}.{t}")]


def fixture_cells(spark: SparkSession) -> DataFrame:
    values = "VALUES ('cell_a', 'POLYGON((0 0,100 0,100 100,0 100,0 0))'), ('cell_b', 'POLYGON((100 0,200 0,200 50,100 50,100 0))') AS t(name, wkt)"
    return spark.sql(f"SELECT * FROM {values}").withColumn("ring", vector.parse_wkt(F.col("wkt")))


def intersecting_count(spark: SparkSession) -> DataFrame:
    """Cells that meet the area of interest; touching counts."""
    aoi = spark.sql("SELECT 'POLYGON((50 10,150 10,150 40,50 40,50 10))' AS wkt").select(F.lit(1).alias("id"), vector.parse_wkt(F.col("wkt")).alias("ring"))
    cells = fixture_cells(spark).select(F.col("name").alias("id"), "ring")
    return vector.intersecting_pairs(cells, aoi, 100.0).agg(F.count("*").alias("n"))


def cell_areas(spark: SparkSession) -> DataFrame:
    return fixture_cells(spark).select("name", vector.ring_area(F.col("ring")).alias("area")).orderBy("name")


def top_hotspots(spark: SparkSession, gi: DataFrame, n: int = 20) -> DataFrame:
    gi.createOrReplaceTempView("groundshift_gi")
    return spark.sql(f"SELECT cell_id, z, loss_ha FROM groundshift_gi WHERE significant ORDER BY z DESC, cell_id LIMIT {n}")
