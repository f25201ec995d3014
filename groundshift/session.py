"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rely on: UTC, ANSI and adaptive execution."""
    builder = SparkSession.builder.master(master).appName("groundshift")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package wherever they run: send it to them once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_groundshift_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="groundshift-"), "groundshift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(target)
    # Batches between the JVM and Python workers by size: long texts must not fill an executor's memory.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    context._groundshift_shipped = True
