"""Structured Streaming forms of the catalogue operators (an extension: the batch forms are the reference ones)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundshift.operators import scenes as ops
from groundshift.sources import fixtures as fx


def month_counts(stream: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Scenes of each calendar month; a month is final once the watermark has passed it."""
    return stream.withWatermark("datetime", lateness).groupBy(F.window("datetime", "1 day").alias("day")).agg(F.count("*").alias("n"))


def best_scene(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """The best scene of each tile and day among those known and a new batch: a late better one supersedes."""
    both = batch if known is None else batch.unionByName(known)
    return ops.ranked(both).filter("place = 1 and tile is not null").select(*batch.columns)


def _drain(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()


def counts_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive the streaming count over the orders table to its end and sum days to months."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
    counted = month_counts(stream.select(F.col("o_orderdate").cast("timestamp").alias("datetime")))
    name = f"months_{uuid.uuid4().hex}"
    _drain(counted.writeStream.outputMode("complete").format("memory").queryName(name).start())
    return spark.table(name).groupBy(F.date_format("day.start", "yyyy-MM").alias("ym")).agg(F.sum("n").alias("n"))


def best_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scene of each tile and day, kept up to date micro-batch by micro-batch in a table of the shared folder.

    Each batch writes the table anew from the one before and its own scenes; the rows returned are those of the last.
    """
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    name, written = f"{root}/groundshift/best-{uuid.uuid4().hex}", []

    def upsert(batch: DataFrame, epoch: int) -> None:
        known = spark.read.parquet(written[-1]) if written else None
        best_scene(fx.scenes_of(batch), known).write.mode("overwrite").parquet(f"{name}/{epoch}")
        written.append(f"{name}/{epoch}")

    _drain(stream.writeStream.foreachBatch(upsert).trigger(availableNow=True).start())
    best = spark.read.parquet(written[-1]) if written else fx.scenes(spark, sf_dir).limit(0)
    return ops.ranked(best).select("id", "tile", "day")
