"""File sources and sinks, configuration, manifests, tables and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundshift.operators import raster
from groundshift.plans import spatial_sql
from groundshift.sources import config, files, geotiff, manifest, osm


def item(i, day, tile="44RKU", base="05.00", flag=None, offset=None, bbox=(77.0, 30.0, 78.0, 31.0)):
    props = {"datetime": f"{day}T05:00:00Z", "platform": "sentinel-2a", "eo:cloud_cover": 5.0, "s2:mgrs_tile": tile, "s2:processing_baseline": base}
    if flag is not None:
        props["earthsearch:boa_offset_applied"] = flag
    assets = {"B04": {"href": "x", "raster:bands": [{"scale": 0.0001, "offset": offset}]}} if offset is not None else {}
    return {"id": i, "properties": props, "assets": assets, "bbox": list(bbox)}


def test_items(spark, tmp_path):
    for it in (item("a", "2024-11-05"), item("b", "2024-11-05", base="02.00"), item("c", "2024-12-01", tile="43RGP", flag=True, offset=-0.1), item("far", "2024-11-06", bbox=(10, 10, 11, 11))):
        (tmp_path / f"{it['id']}.json").write_text(json.dumps(it))
    items = files.read_items(spark, f"file://{tmp_path}/*.json")
    found = files.search_items(items, (77.5, 30.2, 77.9, 30.6), "2024-11-01", "2025-03-31", 20.0)
    assert [r.id for r in found.collect()] == ["a", "c"]
    coef = {r.scene_id: (r.scale, r.offset) for r in files.band_coefficients(items, "B04").collect()}
    assert coef["c"] == (0.0001, 0.0) and coef["a"] == (0.0001, -0.1) and coef["b"] == (0.0001, 0.0)
    out = f"file://{tmp_path}/cache"
    files.write_items(items, out, "aws", "t2")
    assert (tmp_path / "cache/items/provider=aws/epoch=t2").is_dir() and not (tmp_path / "cache/items/provider=pc").exists()
    made = []
    for _ in range(2):
        files.cached(spark, f"file://{tmp_path}/kept", lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]


def test_geojson_and_labels(spark, tmp_path):
    (tmp_path / "aoi.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [3, 4]}}]}))
    rows = files.read_geojson(spark, f"file://{tmp_path}/aoi.geojson").collect()
    assert [(r.kind, len(r.ring)) for r in rows] == [("Polygon", 4), ("Point", 1)]
    (tmp_path / "labels.csv").write_text("id,lon,lat,class_t1,class_t2,labeller\n1,77.9,30.2,1,x,a\n")
    row = files.read_labels(spark, f"file://{tmp_path}/labels.csv").first()
    assert row.class_t1 == 1 and row.class_t2 is None
    (tmp_path / "bad.csv").write_text("id,lon\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_labels(spark, f"file://{tmp_path}/bad.csv")
    files.write_candidates(spark.range(3), f"file://{tmp_path}/cand")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/cand/labels").columns[0] == "id"


def test_composite_sink_and_mosaic(spark, tmp_path):
    rows = [("t1", r, c, *[float(r + c)] * 6) for r in range(4) for c in range(4)]
    comp = spark.createDataFrame(rows, "epoch string, row int, col int, " + ", ".join(f"{b} float" for b in raster.BANDS))
    stats = {r.band: (r.n, r.min_v, r.max_v) for r in files.write_composite(comp, f"file://{tmp_path}/c", 2).collect()}
    assert stats["b02"] == (16, 0.0, 6.0) and len(list((tmp_path / "c/epoch=t1").iterdir())) == 4
    a = spark.createDataFrame([(0, 0, None), (0, 1, 5.0)], "row int, col int, v double")
    b = spark.createDataFrame([(0, 0, 7.0), (0, 1, 9.0)], "row int, col int, v double")
    assert sorted(map(tuple, files.mosaic([a, b], "v").collect())) == [(0, 0, 7.0), (0, 1, 5.0)]


def test_geotiff_round_trip(spark, tmp_path):
    geotiff.register(spark)
    grid = spark.range(600).select(F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col")).withColumns({"b02": F.col("row") * 1.5, "b03": F.when(F.col("col") > 0, F.col("col") * 2.0)})
    grid.coalesce(1).write.format("geotiff").mode("append").option("path", f"file://{tmp_path}/t").option("x_min", "203410").option("y_max", "3369020").save()
    index = json.loads((tmp_path / "t/index.json").read_text())
    path = f"file://{tmp_path}/t/{index['files'][0]}"
    p = geotiff.profile(path)
    assert (p["width"], p["height"], p["bands"], p["epsg"], p["x_min"], p["y_max"], p["size"], p["nodata"]) == (30, 20, 2, 32644, 203410.0, 3369020.0, 10.0, -9999.0)
    back = spark.read.format("geotiff").option("bands", "b02,b03").option("path", path).load()
    assert back.exceptAll(grid).count() == 0 and grid.exceptAll(back).count() == 0
    big = np.arange(400 * 500 * 2, dtype=np.float32).reshape(400, 500, 2)
    (tmp_path / "big.tif").write_bytes(geotiff.encode(big, 0, 0, 1, 32644, -1))
    reader = geotiff.TiffReader(f"{tmp_path}/big.tif", ["x", "y"])
    assert len(reader.partitions()) > 4 and sum(b.num_rows for q in reader.partitions() for b in reader.read(q)) == 200_000


def test_config_and_manifest(spark, tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("epochs: {t1: {start: 2018}, t2: {start: 2024}}\npaths: {out: data}\n")
    monkeypatch.setenv("GROUNDSHIFT_SEED", "7")
    cfg = config.load_config(tmp_path / "c.yaml", True)
    assert cfg["seed"] == "7" and len(config.config_hash(cfg)) == 12 and (tmp_path / "data").is_dir() and config.get_epoch(cfg, "t1")["start"] == 2018
    with pytest.raises(KeyError):
        config.get_epoch(cfg, "t3")
    m = manifest.RunManifest(config.config_hash(cfg), {"k": 1})
    m.start_timer("step")
    m.add_scenes("t1", ["a"], ["2018-11-01"])
    m.add_stats("t1", mean=0.5)
    m.add_results(n=3)
    assert m.stop_timer("step") >= 0
    m.save(spark, f"file://{tmp_path}/runs")
    saved = json.loads(spark.read.json(f"file://{tmp_path}/runs").first().manifest)
    assert saved["results"] == {"n": 3} and saved["scenes"]["t1"]["ids"] == ["a"]


def test_tables(spark):
    assert spatial_sql.missing_tables(spark) == list(spatial_sql.DDL)
    spatial_sql.create_tables(spark)
    assert spatial_sql.missing_tables(spark) == []


def test_osm_queries():
    assert osm.query_text("rivers", (77.9, 30.2, 78.1, 30.4)) == '[out:json][timeout:60];way["waterway"~"^(river|stream|canal)$"](30.2,77.9,30.4,78.1);out geom;'


def test_gpkg_round_trip(spark, tmp_path):
    from groundshift.operators import vector
    from groundshift.sources import gpkg

    df = spark.range(2).select(F.format_string("c%d", "id").alias("name"), vector.box_ring(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(2)).alias("ring"))
    gpkg.write(df, f"{tmp_path}/a.gpkg", "cells", 32644)
    back = gpkg.read(spark, f"{tmp_path}/a.gpkg", "cells")
    assert back.select("name", "ring").collect() == df.collect() and back.first().srid == 32644


def test_boundary_chains_open_ways(spark):
    from groundshift.plans import workflows

    p = lambda *xy: [(float(x), float(y)) for x, y in xy]
    ways = spark.createDataFrame([(1, p((0, 0), (1, 0), (1, 1))), (2, p((0, 0), (0, 1), (1, 1))), (3, p((5, 5), (6, 6)))], "osm_id long, geom array<struct<x:double,y:double>>")
    rings = workflows.boundary(ways).collect()
    assert len(rings) == 1 and len(rings[0].ring) == 5


def test_workflow_needs_months(spark):
    from groundshift.plans import workflows

    with pytest.raises(ValueError, match="months"):
        workflows.epoch_composite(spark.range(1), "t1", month_balanced=True)
