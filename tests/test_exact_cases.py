"""Cases that the rectangular, gap-free fixtures don't reach."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from groundshift.operators import accuracy, focal, vector
from groundshift.plans import workflows
from groundshift.streaming import months

RING = "id long, ring array<struct<x:double,y:double>>"


def test_rings_intersect_by_shape_not_by_box(spark):
    triangle = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    ell = [(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    left = spark.createDataFrame([(1, triangle), (2, ell), (3, box(-50.0, -50.0, 100.0, 100.0))], RING)
    right = spark.createDataFrame([(1, box(8.0, 8.0, 2.0, 2.0)), (2, box(5.0, 5.0, 1.0, 1.0)), (3, box(1.0, 1.0, 0.5, 0.5)), (4, box(10.0, 0.0, 5.0, 1.0)), (5, box(-4.0, 4.0, 20.0, 1.0))], RING)
    got = sorted((r.left_id, r.right_id) for r in vector.intersecting_pairs(left, right, 7.0).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5)]


def test_gradients_pass_gaps_on(spark):
    rows = [(0, 0, 0.0), (0, 1, 1.0), (0, 2, None), (0, 3, 3.0), (0, 5, 9.0), (0, 6, 12.0)]
    got = {r.col: r.dz_dx for r in focal.gradients(spark.createDataFrame(rows, "row int, col int, elevation double"), 1.0).collect()}
    assert got == {0: 1.0, 1: None, 2: 1.0, 3: None, 5: None, 6: 3.0}


def test_area_adjusted_needs_samples_of_every_stratum(spark):
    areas = spark.createDataFrame([(1, 10.0), (2, 30.0)], "stratum int, area double")
    counts = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 2, 10)], "stratum int, class_id int, n long")
    got = {r.class_id: r.area for r in accuracy.area_adjusted(areas, counts).collect()}
    assert got == {1: 8.0, 2: 32.0} and math.isclose(sum(got.values()), 40.0)
    with pytest.raises(Exception, match="no samples"):
        accuracy.area_adjusted(areas, counts.filter("stratum = 1")).collect()


def test_rasters_are_clipped_to_all_rings(spark):
    pixels = spark.range(36).select((F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    box = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0), (x, y)]
    rings = spark.createDataFrame([(1, box(0.0, 0.0)), (2, box(4.0, 4.0))], RING)
    got = {(r.row, r.col) for r in workflows.clip_raster(pixels, pixels.select("row", "col"), "v", rings, 1.0, 0.0, 6.0, 1.0, categorical=True).collect()}
    assert got == {(4, 0), (4, 1), (5, 0), (5, 1), (0, 4), (0, 5), (1, 4), (1, 5)}


def test_best_scene_is_what_the_stream_wrote(spark, monkeypatch):
    """A batch that writes nothing better must show in the result."""
    whole = months.best_of_table(spark, "/root/testdata/sf0.001").count()
    plain = months.best_scene
    monkeypatch.setattr(months, "best_scene", lambda batch, known: plain(batch, known).limit(3))
    assert months.best_of_table(spark, "/root/testdata/sf0.001").count() == 3 < whole
