"""Small fixtures with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from groundshift.functions import special
from groundshift.operators import accuracy, assoc, change, focal, raster, sampling, scenes, text, vector


def pixels(spark, grid, name="class_id"):
    rows = [(r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"row int, col int, {name} int")


def grid_of(df, name="class_id"):
    out = {}
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def test_scl_mask_counts(spark):
    rows = [(c,) for c in [4] * 14 + [8] * 5 + [9] * 4 + [7, 6]]
    got = spark.createDataFrame(rows, "scl int").select(raster.scl_valid(F.col("scl"), (8, 9)).alias("v")).filter("v").count()
    assert got == 16
    assert spark.createDataFrame([(None,), (4,)], "scl int").select(raster.scl_valid(F.col("scl")).alias("v")).collect() == [(False,), (True,)]


@pytest.mark.parametrize("values, median", [([100, 200, 300], 200), ([None, 500, 700], 600), ([None, None], None)])
def test_median_skips_missing(spark, values, median):
    rows = [("t1", 0, 0, *[None if v is None else float(v)] * 6) for v in values]
    df = spark.createDataFrame(rows, "epoch string, row int, col int, " + ", ".join(f"{b} float" for b in raster.BANDS))
    assert raster.median_composite(df).first().b04 == median


def test_month_balanced(spark):
    import datetime as d

    rows = [("t1", 0, 0, d.datetime(2020, 11, k + 1), *[0.0] * 6) for k in range(9)] + [("t1", 0, 0, d.datetime(2020, 12, 1), *[10.0] * 6), ("t1", 0, 0, d.datetime(2021, 1, 1), *[20.0] * 6)]
    df = spark.createDataFrame(rows, "epoch string, row int, col int, ts timestamp, " + ", ".join(f"{b} float" for b in raster.BANDS))
    assert raster.month_balanced_composite(df).first().b02 == 10.0


def test_normalized_difference(spark):
    df = spark.createDataFrame([(4000.0, 1000.0), (1000.0, 1000.0), (0.0, 0.0), (500.0, -500.0), (10000.0, -2000.0), (None, 1.0)], "a float, b float")
    got = [r[0] for r in df.select(raster.normalized_difference(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.6) and got[1:] == [0.0, None, None, 1.0, None]


def test_rule_priority(spark):
    v = zip([0.8, 0.6, 0.6, 0.4, 0.1, 0.1], [0.9, 0.7, 0.1, -0.1, -0.1, -0.1], [0.1, -0.1, -0.1, -0.1, -0.1, -0.1], [0.9, 0.9, -0.1, -0.1, 0.2, 0.0], strict=True)
    df = spark.createDataFrame(list(v), "ndvi float, ndbi float, mndwi float, bsi float")
    assert [r[0] for r in df.select(raster.rule_class()).collect()] == [5, 1, 2, 3, 4, 0]


def test_reflectance_rule(spark):
    rows = [(True, True, -0.1, "05.11", "2025-01-01", 0.0), (False, True, -0.1, "05.11", "2025-01-01", 0.0), (False, True, 0.0, "05.11", "2025-01-01", -0.1), (None, False, -0.1, "05.11", "2025-01-01", -0.1), (None, False, 0.0, "05.11", "2025-01-01", -0.1), (None, False, 0.0, "02.12", "2019-01-01", 0.0), (True, True, 0.0, "05.11", "2025-01-01", 0.0), (None, False, 0.0, "n/a", "2025-01-01", 0.0)]
    df = spark.createDataFrame(rows, "flag boolean, present boolean, offset double, baseline string, day string, want double")
    got = df.select(raster.reflectance_offset(F.col("offset"), F.col("baseline"), F.col("day"), F.col("present"), F.col("flag")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_transition_and_joint_nodata(spark):
    grid = [(r, c, 2, 1 if r == 0 else 2) for r in range(5) for c in range(5)]
    pairs = spark.createDataFrame(grid, "row int, col int, c1 int, c2 int")
    m = {(r.c1, r.c2): r.pixels for r in change.transition_matrix(pairs).collect()}
    assert len(m) == 25 and m[2, 2] == 20 and m[2, 1] == 5
    assert change.key_transitions(pairs).first().vegetation_to_built_km2 == 0.0005
    f = change.footprint(spark.createDataFrame([(0, 0, 2, 3), (0, 1, None, 2), (1, 0, 0, 4), (1, 1, 5, 5)], "row int, col int, c1 int, c2 int")).first()
    assert (f.valid_km2, f.excluded_px, f.excluded_pct, f.footprint_km2) == (0.0002, 2, 50.0, 0.0004)


def test_change_mask(spark):
    pairs = spark.createDataFrame([(0, 0, 2, 2), (0, 1, 2, 1), (1, 0, 4, 1), (1, 1, 1, 1)], "row int, col int, c1 int, c2 int")
    assert grid_of(change.change_masks(pairs), "urban") == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}


def test_ndvi_decline(spark):
    a = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.2), (1, 0, None), (1, 1, 0.4)], "row int, col int, ndvi float")
    b = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.1), (1, 0, 0.2), (1, 1, 0.5)], "row int, col int, ndvi float")
    got = change.ndvi_decline(a, b).withColumn("m", change.encode_mask(F.col("declined")))
    assert grid_of(got, "m") == {(0, 0): 1, (0, 1): 0, (1, 0): 255, (1, 1): 0}


def test_majority_and_sieve(spark):
    assert grid_of(focal.majority_filter(pixels(spark, [[1, 2, 1], [2, 1, 2], [1, 2, 1]])))[1, 1] == 1
    ring = [[2, 2, 2], [2, 0, 2], [2, 2, 2]]
    assert grid_of(focal.majority_filter(pixels(spark, ring)))[1, 1] == 0
    island = pixels(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1]])
    assert grid_of(focal.remove_small_patches(island, 0.02))[1, 1] == 0
    both = grid_of(focal.postprocess(island, 3, 0.02))
    assert both[1, 1] == 1 and 0 not in both.values()


def test_components_across_tiles(spark):
    grid = [[1] * 9, [0] * 8 + [1], [1] * 9]
    labels = {r["label"] for r in focal.component_labels(pixels(spark, grid).filter("class_id <> 0"), tile=2).collect()}
    assert labels == {0}


def test_sieve_connectivity(spark):
    grid = pixels(spark, [[1, 0], [0, 1]])
    assert set(grid_of(focal.remove_small_patches(grid, 0.02, connectivity=4)).values()) == {0}
    assert sum(grid_of(focal.remove_small_patches(grid, 0.02, connectivity=8)).values()) == 2


def test_flat_terrain(spark):
    dem = pixels(spark, [[500] * 4] * 4, "elevation")
    assert all(r.slope == 0 for r in focal.slope_aspect(dem.withColumn("elevation", F.col("elevation").cast("double"))).collect())


def test_scene_dedup(spark):
    import datetime as d

    day = d.datetime(2019, 3, 16)
    rows = [("S2C", "Sentinel-2C", "44RKU", day, "05.00"), ("S2A", "sentinel-2a", "44RKU", day, "05.00"), ("old", "sentinel-2b", "44RKU", day, "00.01"), ("x1", "sentinel-2a", None, day, "01.00"), ("x2", "sentinel-2a", None, day, "01.00"), ("S2B_44RKV_20190316_0_L2A", "sentinel-2b", None, day, "05.00")]
    df = spark.createDataFrame(rows, "id string, platform string, mgrs string, datetime timestamp, baseline string")
    assert {r.id for r in scenes.deduplicated(df).collect()} == {"S2A", "x1", "x2", "S2B_44RKV_20190316_0_L2A"}
    reasons = {r.id: (r.kept_id, r.reason) for r in scenes.drop_audit(df).collect()}
    assert reasons == {"S2C": ("S2A", "same-baseline platform/item tie-break"), "old": ("S2A", "lower processing baseline")}


def test_area_adjusted(spark):
    areas = spark.createDataFrame([(1, 60.0), (2, 40.0)], "stratum int, area double")
    counts = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 1, 1), (2, 2, 9)], "stratum int, class_id int, n long")
    got = {r.class_id: r.area for r in accuracy.area_adjusted(areas, counts).collect()}
    assert got == {1: pytest.approx(52), 2: pytest.approx(48)}
    with pytest.raises(Exception, match="no samples"):
        accuracy.area_adjusted(areas, spark.createDataFrame([(1, 1, 0), (2, 1, 3)], "stratum int, class_id int, n long")).collect()


def test_kappa_and_warnings(spark):
    rows = [(i, who, c) for i, c in ((1, 2), (2, 3)) for who in "ab"]
    labels = spark.createDataFrame(rows, "id int, who string, cls int")
    assert tuple(accuracy.interrater(labels, "id", "who", "cls", "a", "b").first()) == (2, 1.0, 1.0)
    many = spark.createDataFrame([(1,)] * 35 + [(2,)] * 5, "cls int")
    assert [r.warning for r in accuracy.label_warnings(many, "cls").collect()] == ["Class 2 has 5 labels, fewer than 30"]


def test_association(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.0), (1, 0, 1, 1.0), (2, 0, 2, 0.0), (3, 1, 0, 1.0), (4, 1, 1, 4.0), (5, 1, 2, 1.0)], "cell_id int, row_idx int, col_idx int, v double").withColumn("u", F.col("v"))
    edges = assoc.queen_edges(cells)
    assert edges.count() == 22
    assert assoc.spearman(cells, "u", "v").first().rho == 1.0
    assert assoc.morans_i(cells, edges, "v").first().morans_i is not None
    p = assoc.morans_permutation(cells, edges, "v", 19, 17).first()
    assert 0.05 <= p.p_sim <= 1 and p.permutations == 19
    flat = cells.withColumn("v", F.lit(1.0))
    assert assoc.morans_i(flat, edges, "v").first().morans_i is None and assoc.spearman(flat, "u", "v").first().rho is None
    assert assoc.hotspots(assoc.gi_star(cells, edges, "v", 0.99), 2).count() <= 2


def test_special_functions(spark):
    assert spark.range(1).select(special.normal_tail(F.lit(1.6448536269514722))).first()[0] == pytest.approx(0.05)
    assert special.t_tail(0.5, 12) == pytest.approx(0.0978, abs=2e-4)
    assert special.t_tail(1.0, 5) == 0.0 and special.t_tail(None, 5) is None


def test_utm_corner_round_trip(spark):
    df = spark.createDataFrame([(77.9, 30.2), (78.1, 30.4)], "lon double, lat double")
    x, y = vector.utm_forward(F.col("lon"), F.col("lat"))
    lon, lat = vector.utm_inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-9) and r.b == pytest.approx(r.lat, abs=1e-9)


def test_geometry(spark):
    df = spark.range(1).select(vector.box_ring(F.lit(0), F.lit(0), F.lit(10), F.lit(20)).alias("ring"), vector.parse_wkt(F.lit("LINESTRING (0 0, 3 4)")).alias("line"))
    r = df.select(vector.ring_area(F.col("ring")).alias("a"), vector.line_length(F.col("line")).alias("l"), vector.contains_point(F.col("ring"), F.lit(5.0), F.lit(5.0)).alias("i"), vector.contains_point(F.col("ring"), F.lit(10.0), F.lit(5.0)).alias("e")).first()
    assert tuple(r) == (200.0, 5.0, True, False)
    buffered = spark.range(1).select(vector.buffer_convex(vector.box_ring(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), 2.0).alias("g")).select(*[c.alias(n) for n, c in vector.bounds(F.col("g")).items()]).first()
    assert [round(v, 9) for v in buffered] == [-2, -2, 12, 12]
    for size, n, total in ((100, 1, 10000), (150, 4, 22500)):
        net = vector.fishnet(spark, 0, 0, size, size, 100)
        assert net.count() == n and net.agg(F.sum("area")).first()[0] == total
    with pytest.raises(ValueError):
        vector.fishnet(spark, 0, 0, 1, 1, 0)
    with pytest.raises(ValueError, match="Expected CRS"):
        vector.assert_srid(df, 32644, 4326)


def test_zonal(spark):
    px = spark.createDataFrame([(5.0, 5.0, 1.0), (15.0, 5.0, 2.0), (5.0, 15.0, 3.0), (15.0, 15.0, 4.0)], "x double, y double, v double")
    zones = spark.range(2).select(F.col("id").alias("zone_id"), vector.box_ring(F.col("id") * 100, F.lit(0), F.col("id") * 100 + 20, F.lit(20)).alias("ring"))
    got = {r.zone_id: (r["count"], r["mean"], r["sum"]) for r in vector.zonal_stats(zones, px, "v", 10.0).collect()}
    assert got == {0: (4, 2.5, 10.0), 1: (0, None, None)}
    with pytest.raises(ValueError):
        vector.zonal_stats(zones, px, "v", 10.0, ("mode",))


def test_sampling(spark):
    grid = pixels(spark, [[1, 2, 3, 4, 5]] * 20)
    a = sorted(map(tuple, sampling.stratified_sample(grid, 3, 1).collect()))
    assert len(a) == 15 and a == sorted(map(tuple, sampling.stratified_sample(grid, 3, 1).collect()))
    assert sampling.stratified_sample(pixels(spark, [[1, 3, 5, 5]]), 3, 1).count() == 4
    pts = spark.createDataFrame([(i, i * 6000.0, 0.0) for i in range(10)], "id int, x double, y double")
    held = sampling.block_holdout(pts, 5000.0, 0.3, 1)
    assert held.filter("is_test").select("block").distinct().count() == math.ceil(0.3 * held.select("block").distinct().count())


PROVENANCE = [("Area was 12.35 ha.", '{"area_ha": 12.345}', "numeric_value_not_in_results"), ("1.2 km²", '{"area_ha": 1.2}', "unit_mismatch"), ("85%", '{"coverage_fraction": 0.85}', "numeric_value_not_in_results"), ("85%", '{"coverage_pct": 85}', None), ("2024", '{"run_year": 2025}', "numeric_value_not_in_results")]


@pytest.mark.parametrize("narrative, results, reason", PROVENANCE)
def test_provenance(spark, narrative, results, reason):
    df = spark.createDataFrame([(1, narrative, results)], "id int, t string, r string")
    got = text.provenance(text.number_tokens(df, "id", "t"), text.number_sources(df, "id", "r"), "id").collect()
    assert [r.reason for r in got] == [reason]


@pytest.mark.parametrize("line, flagged", [("due to growth", True), ("because of growth", True), ("responsible for", True), ("it CAUSED loss", True), ("co-occurs with", False), ("causeway", False)])
def test_lint(spark, line, flagged):
    assert bool(spark.range(1).select(text.causal_terms(F.lit(line))).first()[0]) == flagged


@pytest.mark.parametrize("token, key", [("1,234.50", "1234.5"), ("85%", "85"), ("+007", "7"), ("0.0", "0"), ("x", None), ("-2.50", "-2.5")])
def test_number_key(spark, token, key):
    assert spark.range(1).select(text.number_key(F.lit(token))).first()[0] == key
