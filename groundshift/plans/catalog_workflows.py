"""Registered queries of the workflows, windows and offset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import assoc, change, text, vector, windows
from groundshift.plans import catalog, workflows
from groundshift.plans.catalog import add
from groundshift.plans.catalog_more import _parcels, _values
from groundshift.plans.oracle import median, query
from groundshift.sources import fixtures as fx



def text_head() -> str:
    """The fixed part of the planner prompt."""
    return f"Return one JSON object with the keys {', '.join((*text.PLAN_FIELDS, 'refusal_reason'))}. status is ready or refuse. Allowed metrics: {', '.join(text.METRICS)}. Allowed tools: {', '.join(text.TOOLS)}. epoch is t1, t2 or null. Refuse causal claims and forecasts. Never state numbers. Question: "


_MONTHS = "(select month(ts) as m from px where epoch = 't1' intersect select month(ts) from px where epoch = 't2')"


def _balanced(s: SparkSession, d: str) -> DataFrame:
    px = fx.px_obs(s, d)
    months = px.filter("epoch is not null").groupBy(F.month("ts").alias("m")).agg(F.count_distinct("epoch").alias("e")).filter("e = 2")
    out, _, _ = workflows.epoch_composite(px, "t2", [r.m for r in months.collect()], month_balanced=True)
    return out.select("row", "col", "b04", "b08")


_TWO = ", ".join(median(b) for b in ("b04", "b08"))
add("workflow_epoch_composite", _balanced, query(f'select "row", col, {_TWO} from (select "row", col, {_TWO} from masked where epoch = \'t2\' and month(ts) in (select m from {_MONTHS}) group by "row", col, month(ts)) group by "row", col', "masked"))
add("workflow_smoke_test", lambda s, d: workflows.smoke_test(fx.px_obs(s, d).filter("epoch is not null"), side=40), query(f'select epoch, "row", col, {median("b04")} from masked where scene_id in (select scene_id from px where epoch is not null order by ts, scene_id limit 3) group by 1, 2, 3', "masked"))
add("stack_scan", lambda s, d: workflows.load_stack(fx.px_obs(s, d).withColumnRenamed("b04", "red"), ("b04", "b08"), (5, 9), (10, 19), {"red": "b04"}).select("scene_id", "row", "col", "b04", "b08"), query('select scene_id, "row", col, b04, b08 from px where "row" between 5 and 9 and col between 10 and 19', "px"))


def _classes(s: SparkSession, d: str, epoch: str) -> DataFrame:
    return fx.lulc(s, d).filter(F.col("epoch") == epoch).select("row", "col", "class_id")


def _run(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return workflows.change_run(_classes(s, d, "t1"), _classes(s, d, "t2"), least_ha=0.0)


_MAJ = """(select "row", col, case when centre = 0 then 0 else vote end as class_id from (select s."row", s.col, s.class_id as centre, n.class_id as vote, row_number() over (partition by s."row", s.col order by count(n.class_id) desc, (n.class_id = s.class_id) desc, n.class_id) as k
 from (select * from lulc where epoch = '{0}') s left join (select * from lulc where epoch = '{0}') n on n.class_id <> 0 and abs(n."row" - s."row") <= 1 and abs(n.col - s.col) <= 1 group by s."row", s.col, s.class_id, n.class_id) where k = 1)"""
_CLEAN = f'(select "row", col, a.class_id as c1, b.class_id as c2 from {_MAJ.format("t1")} a join {_MAJ.format("t2")} b using ("row", col))'
add("workflow_change_matrix", lambda s, d: _run(s, d)["matrix"].select("c1", "c2", "pixels"), query(f"select f.c1, f.c2, count(p.c1) as pixels from frame f left join {_CLEAN} p on p.c1 = f.c1 and p.c2 = f.c2 group by 1, 2", "lulc", "frame"))
add("workflow_association", lambda s, d: workflows.association_run(change.change_masks(fx.class_pair(s, d)), 4, 10)["moran"], catalog.ORACLES["morans_i"])
add("workflow_association_p", lambda s, d: workflows.association_run(change.change_masks(fx.class_pair(s, d)), 4, 10)["moran_p"])
add("terrain_features", lambda s, d: workflows.terrain_features(fx.dem(s), s.range(100).select((F.floor(F.col("id") / 10) + 2).cast("int").alias("row"), (F.col("id") % 10 + 2).cast("int").alias("col")), 1.0).select("row", "col", F.round("slope", 6).alias("slope"), (F.round("aspect_sin", 6) + F.lit(0.0)).alias("aspect_sin")), query('select "row", col, round(degrees(atan(sqrt(dz_dx * dz_dx + dz_dy * dz_dy))), 6) as slope, round(sin(atan2(-dz_dx, dz_dy)), 6) + 0.0e0 as aspect_sin from grad where "row" between 2 and 11 and col between 2 and 11', "grad"))


def _clipped(s: SparkSession, d: str) -> DataFrame:
    ring = s.range(1).select(vector.box_ring(F.lit(50), F.lit(100), F.lit(250), F.lit(300)).alias("ring"))
    return workflows.clip_raster(_classes(s, d, "t2"), fx.spine(s), "class_id", ring, 1.0, 0.0, 400.0, 10.0, categorical=True)


add("raster_clip", _clipped, query('select "row", col, class_id from t2 where col * 10 + 5 >= 50 and col * 10 + 5 < 250 and 400 - ("row" * 10 + 5) >= 100 and 400 - ("row" * 10 + 5) < 300', "t2"))
_TEXTS = ["77.9,30.2", " 78 , 30.5 ", "200,10", "a,b", "1,2,3", "10,-91", ""]
add("parse_center", lambda s, d: s.createDataFrame([(i, t) for i, t in enumerate(_TEXTS)], "id int, t string").select("id", windows.parse_center(F.col("t")).alias("c")).select("id", "c.lon", "c.lat"), "select * from (values (0, 77.9::double, 30.2::double), (1, 78, 30.5), (2, null, null), (3, null, null), (4, null, null), (5, null, null), (6, null, null)) t(id, lon, lat)")
add("target_grid", lambda s, d: windows.target_grid(s.createDataFrame([(81.0, 0.0)], "lon double, lat double"), "lon", "lat").select(F.round("x_min", 3).alias("x_min"), (F.round("y_min", 3) + F.lit(0.0)).alias("y_min"), F.round("x_max", 3).alias("x_max"), F.round("y_max", 3).alias("y_max"), "pixels"), "select 499500.0::double as x_min, -500.0::double as y_min, 500500.0::double as x_max, 500.0::double as y_max, 100 as pixels")
_PARCEL = "(select s_suppkey as id, (s_suppkey * 137 % 1000)::double as x0, (s_suppkey * 211 % 1000)::double as y0, s_suppkey % 50 + 1 as w, s_suppkey % 70 + 1 as h from supplier)"
add("centred_window", lambda s, d: windows.centred_window(_parcels(s, d), 0.02).select("id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.col("window").isNotNull().alias("fits")), f"select id, round(x0 + w / 2.0, 6)::double as cx, round(y0 + h / 2.0, 6)::double as cy, w >= 20 and h >= 20 as fits from {_PARCEL}")


def _snap(s: SparkSession, d: str) -> DataFrame:
    left, top = windows.snapped_window(F.col("x"), F.col("y"), 100)
    return fx.labels_ref(s, d).select("id", left.cast("double").alias("left"), top.cast("double").alias("top"))


add("snap_window", _snap, query("select id, floor((x - 500) / 10) * 10.0::double as left, ceil((y + 500) / 10) * 10.0::double as top from labels_ref", "labels_ref"))
add("flag_text", lambda s, d: fx.scenes(s, d).select("id", windows.flag_text(F.col("boa_flag")).alias("flag")), query("select id, case boa_flag when true then 'true' when false then 'false' else 'absent' end as flag from scenes", "scenes"))
add("epoch_records", lambda s, d: windows.epoch_records(fx.scenes(s, d), catalog.EDGE_YEAR), query("select case when year(datetime) < 1998 then 't1' else 't2' end as epoch, coalesce(mgrs, id) as tile, id from scenes where year(datetime) <> 1998", "scenes"))
add("window_reflectance", lambda s, d: windows.window_reflectance(fx.dem(s), "elevation", 10, 10, 8, 8, 0.0001, -0.1).withColumn("elevation", F.round("elevation", 9)), query('select "row" - 10 as "row", col - 10 as col, round(elevation * 0.0001e0 + -0.1e0, 9) as elevation from dem where "row" between 7 and 20 and col between 7 and 20', "dem"))
add("polygon_queen_edges", lambda s, d: assoc.polygon_queen_edges(vector.fishnet(s, 0, 0, 500, 400, 100).select("cell_id", vector.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))), "select a.i as src, b.i as dst from range(20) a(i), range(20) b(i) where a.i <> b.i and abs(a.i // 5 - b.i // 5) <= 1 and abs(a.i % 5 - b.i % 5) <= 1")
add("symmetric_edges", lambda s, d: assoc.symmetric(assoc.queen_edges(catalog._GRID(s, d)).filter("src < dst")), query("select src, dst from edges", "edges"))
add("raster_mosaic", lambda s, d: __import__("groundshift.sources.files", fromlist=["mosaic"]).mosaic([_classes(s, d, "t1").withColumn("class_id", F.nullif(F.col("class_id"), F.lit(0))), _classes(s, d, "t2")], "class_id"), query("select \"row\", col, coalesce(max(case when epoch = 't1' and class_id <> 0 then class_id end), max(case when epoch = 't2' then class_id end)) as class_id from lulc group by 1, 2", "lulc"))
add("normal_tail", lambda s, d: catalog._GI(s, d).select("cell_id", "z", __import__("groundshift.functions.special", fromlist=["normal_tail"]).normal_tail(F.col("z")).alias("p")).select("cell_id", (F.col("p") <= 0.05).alias("small")), query("select cell_id, coalesce(z >= 1.6448536269514715e0, false) as small from gi", "gi"))
add("chunk_grid", lambda s, d: fx.spine(s).select(F.format_string("r%05d_c%05d", F.floor(F.col("row") / 16).cast("int"), F.floor(F.col("col") / 16).cast("int")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("pixels")), query("select 'r' || lpad((\"row\" // 16)::varchar, 5, '0') || '_c' || lpad((col // 16)::varchar, 5, '0') as chunk, count(*) as pixels from spine group by 1", "spine"))
add("line_clip_labels", lambda s, d: fx.labels_ref(s, d).select("id", catalog.sampling.block_key(F.col("x"), F.col("y"), 5000.0).alias("block")), query("select id, floor(x / 5000)::bigint || ':' || floor(y / 5000)::bigint as block from labels_ref", "labels_ref"))
add("wilson_interval", lambda s, d: catalog.accuracy.confusion(fx.labels_ref(s, d), "class_b", "class_a").agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("h"), F.sum("n").alias("n")).select(*[F.round(c, 9).alias(k) for c, k in zip(catalog.accuracy.wilson_interval(F.col("h"), F.col("n")), ("low", "high"), strict=True)]), query("select round((p + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n) - 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4 * n * n)) / (1 + 1.96e0 * 1.96e0 / n), 9) as low, round((p + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n) + 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4 * n * n)) / (1 + 1.96e0 * 1.96e0 / n), 9) as high from (select sum(case when truth = predicted then n else 0 end)::double / sum(n) as p, sum(n)::double as n from conf)", "conf"))
add("unit_of_path", lambda s, d: s.createDataFrame([(p,) for p in ("$.a_ha", "$.x.b_km2", "$.c_pct", "$.d_fraction", "$.year", "$.e")], "path string").select("path", text.unit_of_path(F.col("path")).alias("unit")), _values([("$.a_ha", "ha"), ("$.x.b_km2", "km2"), ("$.c_pct", "percent"), ("$.d_fraction", "fraction"), ("$.year", "year"), ("$.e", None)], "path, unit"))
add("planner_prompt", lambda s, d: fx.table(s, d, "benchmark").select("item_id", text.planner_prompt(F.col("text")).alias("p")).select("item_id", F.col("p").startswith("Return one JSON object").alias("ok"), F.length("p").cast("long").alias("n")), "select item_id, true as ok, " + str(len(text_head())) + " + length(text) as n from benchmark")
