"""Shared plumbing of the training-data operators: durable intermediates and skew-safe lookups."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hot keys are those with more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/groundshift/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and outlives lost executors."""
    spark, path = df.sparkSession, table_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._groundshift_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_groundshift_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for the queries that run inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def join_counted(left: DataFrame, right: DataFrame, key: str, count_col: str, total: int, spread: str) -> DataFrame:
    """Left outer join with a right side of unique, non-null keys that knows how many left rows each key has.

    Keys with more than total/HOT_SHARE rows, fewer than HOT_SHARE by that definition, are broadcast, so their rows
    stay where they are; all others are joined by a shuffle in which no key is hot. `spread` is a column of left
    whose values deal out the rows that need no shuffle partner.
    """
    value_cols = [c for c in right.columns if c not in (key, count_col)]
    limit = max(1000, total // HOT_SHARE)
    pack = F.struct(*[F.col(c) for c in value_cols])
    hot = right.filter(F.col(count_col) > limit).select(F.col(key).alias("_hot_key"), pack.alias("_hot"))
    cold = right.filter(F.col(count_col) <= limit).select(F.col(key).cast("string").alias("_cold_key"), pack.alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    aside = F.concat(F.lit("~"), F.coalesce(F.col(spread).cast("string"), F.lit("")))
    out = out.withColumn("_key", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(aside))
    out = out.join(cold, F.col("_key") == F.col("_cold_key"), "left")
    values = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*left.columns, *[values[c].alias(c) for c in value_cols])


def join_salted(left: DataFrame, right: DataFrame, key: str, right_key: str, spread: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join left (of `total` rows) with a right side of unique keys of which some may have a large share of left's rows.

    Such keys, with more than total/HOT_SHARE rows and so fewer than HOT_SHARE, are broadcast with the number of parts
    that their rows are dealt over by `spread`; only the right rows of these keys are repeated, once for each part.
    """
    counts = left.groupBy(F.col(key).alias("_salt_key")).agg(F.count("*").alias("_n"))
    limit = max(1000, (left.count() if total is None else total) // HOT_SHARE)
    hot = F.broadcast(materialize(counts.filter(F.col("_n") > limit).select("_salt_key", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = left.join(hot, F.col(key) == F.col("_salt_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_salt_key", "_parts")
    copies = right.join(hot, F.col(right_key) == F.col("_salt_key"), "left").withColumn("_right_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salt_key", "_parts")
    return dealt.join(copies, (F.col(key) == F.col(right_key)) & (F.col("_salt") == F.col("_right_salt")), how).drop(right_key, "_salt", "_right_salt")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_threads() -> None:
    """One thread for each worker: Spark already runs one task on each core."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
