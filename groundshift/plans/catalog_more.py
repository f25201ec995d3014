"""Registered queries of the vector, text, learning, SQL and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import ml, text, vector
from groundshift.plans import catalog, spatial_sql
from groundshift.plans.catalog import add
from groundshift.plans.oracle import query
from groundshift.sources import fixtures as fx
from groundshift.sources import osm
from groundshift.streaming import months

# Vector. Points come from the pixel grid: longitudes and latitudes around the study area.
_LON, _LAT = 77.9, 30.2


def _points(s: SparkSession) -> DataFrame:
    return fx.spine(s).select("row", "col", (F.lit(_LON) + F.col("col") * 0.01).alias("lon"), (F.lit(_LAT) + F.col("row") * 0.01).alias("lat"))


def _utm_sql() -> tuple[str, str]:
    """Easting and northing as SQL over lon and lat, from the same series."""
    import math

    radius, alpha, _, _ = vector._series()
    n = vector.FLATTENING / (2 - vector.FLATTENING)
    k = 2 * math.sqrt(n) / (1 + n)
    t = f"(select lon, lat, radians(lon - 81) as dl, sinh(atanh(sin(radians(lat))) - {k!r}::double * atanh({k!r}::double * sin(radians(lat)))) as t, \"row\", col from pts)"
    base = f"(select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(t * t + 1)) as eta from {t})"
    east = "eta" + "".join(f" + {a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    scale = repr(vector.SCALE * radius)
    return base, f"round(500000 + ({east}) * {scale}::double, 4) as x, round(({north}) * {scale}::double, 4) as y"


_BASE, _XY = _utm_sql()
_PTS = f', pts as (select "row", col, {_LON}::double + col * 0.01::double as lon, {_LAT}::double + "row" * 0.01::double as lat from spine) '
add("utm_forward", lambda s, d: _points(s).select("row", "col", *[F.round(c, 4).alias(n) for c, n in zip(vector.utm_forward(F.col("lon"), F.col("lat")), "xy", strict=True)]), query(f'@select "row", col, {_XY} from {_BASE}', "spine").replace(" @", _PTS))


def _inverse(s: SparkSession, d: str) -> DataFrame:
    p = _points(s)
    x, y = vector.utm_forward(F.col("lon"), F.col("lat"))
    lon, lat = vector.utm_inverse(F.col("x"), F.col("y"))
    return p.withColumns({"x": x, "y": y}).select("row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


add("utm_inverse", _inverse, query('@select "row", col, round(lon, 6) as lon, round(lat, 6) as lat from pts', "spine").replace(" @", _PTS))


def _parcels(s: SparkSession, d: str) -> DataFrame:
    """Rectangles of suppliers, side lengths from their keys."""
    k = F.col("s_suppkey")
    x0, y0 = (k * 137 % 1000).cast("double"), (k * 211 % 1000).cast("double")
    return fx.table(s, d, "supplier").select(k.alias("id"), vector.box_ring(x0, y0, x0 + k % 50 + 1, y0 + k % 70 + 1).alias("ring"))


_PARCEL = "(select s_suppkey as id, (s_suppkey * 137 % 1000)::double as x0, (s_suppkey * 211 % 1000)::double as y0, s_suppkey % 50 + 1 as w, s_suppkey % 70 + 1 as h from supplier)"
_CELLS = "(select i as cell, (i % 10) * 100.0::double as cx0, (i // 10) * 100.0::double as cy0, (i % 10) * 100.0::double + 100 as cx1, (i // 10) * 100.0::double + 100 as cy1 from range(100) t(i))"


def _cells(s: SparkSession) -> DataFrame:
    net = vector.fishnet(s, 0, 0, 1000, 1000, 100)
    return net.select(F.col("cell_id").cast("long").alias("id"), vector.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


add("polygon_area", lambda s, d: _parcels(s, d).select("id", vector.ring_area(F.col("ring")).alias("area")), f"select id, (w * h)::double as area from {_PARCEL}")
add("line_length", lambda s, d: _parcels(s, d).select("id", vector.line_length(F.col("ring")).alias("perimeter")), f"select id, 2.0::double * (w + h) as perimeter from {_PARCEL}")
add("buffer_bounds", lambda s, d: _parcels(s, d).select("id", *[c.alias(n) for n, c in vector.buffer_bounds(F.col("ring"), 2.0).items()]), f"select id, x0 - 2 as x0, y0 - 2 as y0, x0 + w + 2.0::double as x1, y0 + h + 2.0::double as y1 from {_PARCEL}")
add("buffer_area", lambda s, d: _parcels(s, d).select("id", vector.buffer_convex(F.col("ring"), 2.0).alias("round")).select("id", F.round(vector.ring_area(F.col("round")), 4).alias("area")), f"select id, round(w * h + 4 * (w + h) + 128 * sin(2 * pi() / 64), 4) as area from {_PARCEL}")
add("fishnet", lambda s, d: vector.fishnet(s, 0, 0, 3950, 2000, 1000).select("row_idx", "col_idx", "area"), "select cast(i // 4 as int) as row_idx, cast(i % 4 as int) as col_idx, case when i % 4 = 3 then 950000.0::double else 1000000.0::double end as area from range(8) t(i)")
add("st_intersects_pairs", lambda s, d: vector.intersecting_pairs(_parcels(s, d), _cells(s), 100.0).select("left_id", "right_id"), f"select id as left_id, cell as right_id from {_PARCEL}, {_CELLS} where x0 <= cx1 and cx0 <= x0 + w and y0 <= cy1 and cy0 <= y0 + h")
add("st_intersects_count", lambda s, d: vector.intersecting_pairs(_parcels(s, d), _cells(s), 100.0).agg(F.count("*").alias("n")), f"select count(*) as n from {_PARCEL}, {_CELLS} where x0 <= cx1 and cx0 <= x0 + w and y0 <= cy1 and cy0 <= y0 + h")
add("overlay_area", lambda s, d: vector.overlay(_parcels(s, d), _cells(s), 100.0).select("left_id", "right_id", F.round("area", 6).alias("area")), f"select id as left_id, cell as right_id, round((least(x0 + w, cx1) - greatest(x0, cx0)) * (least(y0 + h, cy1) - greatest(y0, cy0)), 6) as area from {_PARCEL}, {_CELLS} where x0 < cx1 and cx0 < x0 + w and y0 < cy1 and cy0 < y0 + h")

_INSIDE = f"select id as left_id, cell as right_id, (least(x0 + w, cx1) - greatest(x0, cx0)) * (least(y0 + h, cy1) - greatest(y0, cy0)) as area from {_PARCEL}, {_CELLS} where x0 < cx1 and cx0 < x0 + w and y0 < cy1 and cy0 < y0 + h"
_OUTSIDE = f"select id as left_id, null::bigint as right_id, w * h - coalesce((select sum(area) from ({_INSIDE}) i where i.left_id = p.id), 0) as area from {_PARCEL} p where w * h - coalesce((select sum(area) from ({_INSIDE}) i where i.left_id = p.id), 0) > 0"
add("overlay_difference", lambda s, d: vector.overlay(_parcels(s, d), _cells(s), 100.0, "difference").select("left_id", F.round("area", 6).alias("area")), f"select left_id, round(area, 6)::double as area from ({_OUTSIDE})")
add("overlay_identity", lambda s, d: vector.overlay(_parcels(s, d), _cells(s), 100.0, "identity").select("left_id", "right_id", F.round("area", 6).alias("area")), f"select left_id, right_id, round(area, 6)::double as area from ({_INSIDE} union all {_OUTSIDE})")


def _clip(s: SparkSession, d: str) -> DataFrame:
    window = _parcels(s, d).withColumns({"wx0": F.lit(200.0), "wy0": F.lit(100.0), "wx1": F.lit(800.0), "wy1": F.lit(900.0)})
    return vector.clip_boxes(window, "ring", "wx0", "wy0", "wx1", "wy1").select("id", F.round("clipped_area", 6).alias("area"))


add("clip_area", _clip, f"select id, round((least(x0 + w, 800) - greatest(x0, 200)) * (least(y0 + h, 900) - greatest(y0, 100)), 6)::double as area from {_PARCEL} where x0 < 800 and 200 < x0 + w and y0 < 900 and 100 < y0 + h")


def _zones(s: SparkSession, d: str) -> DataFrame:
    px = fx.dem(s).select((F.col("col") * 25 + 12.5).alias("x"), (F.col("row") * 25 + 12.5).alias("y"), "elevation")
    return vector.zonal_stats(_parcels(s, d).withColumnRenamed("id", "zone_id"), px, "elevation", 100.0).select("zone_id", "count", F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"), F.round("min", 6).alias("min"), F.round("sum", 6).alias("sum"))


_ZONAL = query(f'select z.id as zone_id, count(elevation) as count, round(max(elevation), 6) as max, round(avg(elevation), 6) as mean, round(min(elevation), 6) as min, round(sum(elevation), 6) as sum from {_PARCEL} z left join dem on col * 25 + 12.5 >= x0 and col * 25 + 12.5 < x0 + w and "row" * 25 + 12.5 >= y0 and "row" * 25 + 12.5 < y0 + h group by 1', "dem")
add("zonal_stats", _zones, _ZONAL)
add("zonal_empty", lambda s, d: _zones(s, d).filter("count = 0").select("zone_id", "count"), f"select zone_id, count from ({_ZONAL}) where count = 0")
add("sample_raster", lambda s, d: vector.sample_raster(fx.labels_ref(s, d).select("id", "x", (F.lit(20000.0) - F.col("y")).alias("y")), catalog._T2(s, d), 0.0, 20000.0, 500.0).select("id", "class_id"), query('select id, t.class_id from labels_ref l join t2 t using ("row", col)', "labels_ref", "t2"))
add("wkt_area", lambda s, d: spatial_sql.fixture_cells(s).select("name", vector.ring_area(F.col("ring")).alias("area")).orderBy("name"), "select * from (values ('cell_a', 10000.0::double), ('cell_b', 5000.0::double)) t(name, area)")
add("osm_ways", lambda s, d: osm.ways(osm.sample(s)).select("osm_id", "name", "kind", F.size("geom").alias("points"), "closed"), "select * from (values (1::bigint, 'Main', 'primary', 2, false), (2::bigint, '', 'river', 3, false), (3::bigint, '', 'yes', 5, true)) t(osm_id, name, kind, points, closed)")

# SQL over registered tables.
add("sql_intersecting_cells", lambda s, d: spatial_sql.intersecting_count(s), "select 2::bigint as n")
add("sql_cell_areas", lambda s, d: spatial_sql.cell_areas(s), "select * from (values ('cell_a', 10000.0::double), ('cell_b', 5000.0::double)) t(name, area)")
add("sql_hotspots", lambda s, d: spatial_sql.top_hotspots(s, catalog._GI(s, d)), query("select cell_id, round(z, 9) as z, loss_ha from gi where significant order by 2 desc, 1 limit 20", "gi"))

# Text.
_QUESTIONS = ["How much urban expansion in Dehradun?", "Report vegetation loss in Dehradun.", "What is the Spearman rho between urban gain and vegetation loss?", "Report Moran's I for vegetation loss.", "How many significant Gi star hotspots were found?", "What is the NDVI decline area in T2?", "What is valid-pixel coverage for T1?", "valid pixel coverage 2024-25", "Area converted from tree to built-up?", "What caused vegetation loss in Dehradun?", "Forecast flood risk in Mussoorie.", "What is the weather?"]
_EXPECT = ["urban_expansion_ha", "vegetation_loss_ha", "spearman_rho", "morans_i", "hotspot_count", "ndvi_decline_ha", "valid_pixel_t1_pct", "valid_pixel_t2_pct", "tree_to_built_ha", None, None, None]
RESULTS = {"urban_expansion_ha": 12.5, "vegetation_loss_ha": 20.0, "spearman_rho": 0.42, "morans_i": 0.31, "hotspot_count": 4, "ndvi_decline_ha": 7.3, "valid_pixel_t1_pct": 86.2, "valid_pixel_t2_pct": 82.4, "tree_to_built_ha": 5.8}
_CHUNKS = [("change", "Urban expansion is non-built land that became built. Vegetation loss is tree or crop that became something else. Areas are hectares."), ("association", "Spearman rho reports monotonic co-occurrence, Moran I spatial autocorrelation, Gi star local hotspots."), ("ndvi", "NDVI decline is a thresholded spectral difference and shows no cause."), ("coverage", "Valid-pixel coverage is reported separately for T1 and T2 as percent."), ("transitions", "Tree to built-up area is a class transition between two epochs.")]


def questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, q) for i, q in enumerate(_QUESTIONS)], "query_id int, text string")


def chunks(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_CHUNKS, "chunk_id string, text string")


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


_EPOCH = {5: "t2", 6: "t1", 7: "t2"}
add("plan_queries", lambda s, d: questions(s).withColumn("p", text.plan_column(F.col("text"))).select("query_id", "p.status", "p.metric_id", "p.epoch", "p.aoi"), _values([(i, "ready" if m else "refuse", m, _EPOCH.get(i), "Dehradun" if m and "Dehradun" in _QUESTIONS[i] else None) for i, m in enumerate(_EXPECT)], "query_id, status, metric_id, epoch, aoi"))
add("plan_conversations", lambda s, d: fx.table(s, d, "conversations").select("conv_id", "turn", text.plan_column(F.col("text"))["status"].alias("status")), "select conv_id, turn, case when regexp_matches(lower(text), '\\b(cause\\w*|lead to|leads to|led to|result\\w* in|forecast\\w*|predict\\w*|will flood|flood risk|responsible for)\\b') then 'refuse' when regexp_matches(lower(text), 'spearman|rank correlation|moran|hotspot|hot spot|tree to built|tree-to-built|urban expansion|urban gain|built-up gain|vegetation loss|veg loss|ndvi decline|ndvi difference|valid-pixel coverage|valid pixel coverage') then 'ready' else 'refuse' end as status from conversations")
_BAD_PLANS = [(0, "ready", "query_result", "morans_i", None, None, ["read_result", "retrieve_method"], None), (1, "ready", "chat", "unknown", "t3", "Elsewhere", ["read_result"], "why"), (2, "refuse", None, "morans_i", None, None, ["x"], " "), (3, "maybe", None, None, None, None, [], None), (4, "refuse", None, None, None, None, [], "no metric")]
_PLAN = "struct<status:string,intent:string,metric_id:string,epoch:string,aoi:string,tools:array<string>,refusal_reason:string>"
add("validate_plans", lambda s, d: s.createDataFrame([(p[0], p[1:]) for p in _BAD_PLANS], f"id int, plan {_PLAN}").select("id", F.size(text.plan_errors("plan")).alias("n_errors")), _values([(0, 0), (1, 6), (2, 2), (3, 1), (4, 0)], "id, n_errors"))
add("plan_missing_fields", lambda s, d: fx.table(s, d, "events").select("event_id", F.array_join(text.missing_fields(F.col("props")), ",").alias("missing")), "select event_id, 'aoi,epoch,intent,metric_id,refusal_reason,status,tools' as missing from events")


def _trees(s: SparkSession, d: str) -> DataFrame:
    tree = F.concat(F.lit('{"run": {"area_ha": '), F.col("event_id").cast("string"), F.lit(', "flags": [true, null, {"share_pct": '), (F.col("user_id") % 100).cast("string"), F.lit('.50}]}, "props": '), "props", F.lit("}"))
    return fx.table(s, d, "events").select("event_id", tree.alias("tree"))


add("json_number_sources", lambda s, d: text.number_sources(_trees(s, d), "event_id", "tree").select("event_id", "pos", "path", "number", "unit"), "select event_id, 0 as pos, '$.run.area_ha' as path, event_id::varchar as number, 'ha' as unit from events union all select event_id, 1, '$.run.flags[2].share_pct', (user_id % 100)::varchar || '.5', 'percent' from events union all select event_id, 2, '$.props.k', json_extract_string(props, '$.k'), null from events where json_extract_string(props, '$.k') is not null")
add("metric_lookup", lambda s, d: text.lookup_metric(text.number_sources(_trees(s, d), "event_id", "tree"), "event_id", "area_ha"), "select event_id, event_id::varchar as value from events")


def _narratives(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    unit = F.element_at(F.array(F.lit(" ha"), F.lit("%"), F.lit(""), F.lit(" km2")), (k % 4 + 1).cast("int"))
    return fx.table(s, d, "events").select("event_id", F.concat(F.lit("Recorded "), (k + F.when(k % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(".00"), unit, F.lit(" in run A7; share "), F.format_string("%,d", F.col("user_id") + 1000), F.lit(" of all.")).alias("narrative"))


def _prov(s: SparkSession, d: str) -> DataFrame:
    trees = fx.table(s, d, "events").select("event_id", F.concat(F.lit('{"area_ha": '), F.col("event_id").cast("string"), F.lit(', "n": '), (F.col("user_id") + 1000).cast("string"), F.lit("}")).alias("tree"))
    return text.provenance(text.number_tokens(_narratives(s, d), "event_id", "narrative"), text.number_sources(trees, "event_id", "tree"), "event_id").select("event_id", "pos", "number", "stated_unit", "reason")


_FIRST = "event_id + case when event_id % 5 = 0 then 1 else 0 end"
add("number_provenance", _prov, f"select event_id, 0 as pos, ({_FIRST})::varchar as number, u as stated_unit, case when event_id % 5 = 0 and event_id + 1 <> user_id + 1000 or event_id % 5 <> 0 and false then 'numeric_value_not_in_results' when event_id % 5 = 0 then case when u is not null then 'unit_not_declared_in_results' end when event_id = user_id + 1000 and u is not null then 'unit_not_declared_in_results' when u is not null and u <> 'ha' then 'unit_mismatch' end as reason from (select *, case event_id % 4 when 0 then 'ha' when 1 then 'percent' when 3 then 'km2' end as u from events) union all select event_id, 1, (user_id + 1000)::varchar, null, null from events")
add("number_tokens", lambda s, d: text.number_tokens(_narratives(s, d), "event_id", "narrative").select("event_id", "pos", "token", "number"), f"select event_id, 0 as pos, ({_FIRST})::varchar || '.00' || case when event_id % 4 = 1 then '%' else '' end as token, ({_FIRST})::varchar as number from events union all select event_id, 1, '1,' || lpad(user_id::varchar, 3, '0'), (user_id + 1000)::varchar from events")
_TERMS = ["due to", "because of", "CAUSED by", "co-occurs with", "is responsible for", "overdue to"]
add("causal_lint", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", F.array_join(text.causal_terms(F.concat(F.lit("Loss "), F.element_at(F.array(*[F.lit(t) for t in _TERMS]), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" growth."))), ",").alias("matches")), "select o_orderkey, case o_orderkey % 6 when 0 then 'due to' when 1 then 'because of' when 2 then 'caused' when 4 then 'responsible for' else '' end as matches from orders")
add("display_units", lambda s, d: s.createDataFrame([(m,) for m in sorted(RESULTS)], "metric string").select("metric", text.display_unit(F.col("metric")).alias("unit")), _values([(m, "ha" if m.endswith("_ha") else "%" if m.endswith("_pct") else "") for m in sorted(RESULTS)], "metric, unit"))
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TFIDF = f"""with words as (select k, id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w not in ({_STOP})) as w from (select 'c' as k, doc_id as id, text from documents union all select 'q', item_id, text from benchmark)),
 terms as (select k, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words), tf as (select k, id, term, count(*) as tf from terms group by all),
 idf as (select term, ln((1.0::double + (select count(*) from documents)) / (1.0::double + count(*))) + 1 as idf from tf where k = 'c' group by 1), w as (select k, id, term, tf * idf as w from tf join idf using (term)),
 nrm as (select k, id, sqrt(sum(w * w)) as nrm from w group by 1, 2), sc as (select q.id as query_id, c.id as chunk_id, round(sum(c.w * q.w) / (any_value(a.nrm) * any_value(b.nrm)), 6) as score from w c join w q on c.term = q.term and c.k = 'c' and q.k = 'q' join nrm a on a.k = 'c' and a.id = c.id join nrm b on b.k = 'q' and b.id = q.id group by 1, 2)
 select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc where score > 0) where rank <= 3"""
add("tfidf_topk", lambda s, d: text.tfidf_topk(fx.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), fx.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), digits=6).withColumn("rank", F.col("rank").cast("long")), _TFIDF)
add("answer_queries", lambda s, d: text.answers(questions(s), chunks(s), RESULTS).select("query_id", "status", "metric_id", "plan_valid", "lint_passed"), _values([(i, "answered" if m else "refused", m, True, True) for i, m in enumerate(_EXPECT)], "query_id, status, metric_id, plan_valid, lint_passed"))


def _rates(s: SparkSession, d: str) -> DataFrame:
    a = text.answers(questions(s), chunks(s), RESULTS)
    want = s.createDataFrame([(i, m) for i, m in enumerate(_EXPECT)], "query_id int, want string")
    both = a.join(want, "query_id").join(text.answer_provenance(a, RESULTS), "query_id")
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    supported = F.col("want").isNotNull()
    return both.agg(F.count("*").alias("n"), rate(F.col("metric_id").eqNullSafe(F.col("want"))).alias("parameter_rate"), rate(F.when(~supported, F.col("status") == "refused")).alias("refusal_rate"), rate(F.col("plan_valid")).alias("validity_rate"), rate(F.when(supported, F.size("citations") > 0)).alias("citation_rate"), rate(F.col("passed")).alias("provenance_rate"), rate(F.col("lint_passed")).alias("lint_rate"))


add("benchmark_rates", _rates, "select 12::bigint as n, 1.0::double as parameter_rate, 1.0::double as refusal_rate, 1.0::double as validity_rate, 1.0::double as citation_rate, 1.0::double as provenance_rate, 1.0::double as lint_rate")


def _gold(s: SparkSession, d: str) -> DataFrame:
    plans = questions(s).select(F.col("query_id").alias("id"), text.plan_column(F.col("text")).alias("plan"))
    gold = plans.withColumn("plan", F.when(F.col("id") % 4 == 0, F.col("plan").withField("epoch", F.lit("t1"))).otherwise(F.col("plan")))
    return text.gold_match(plans, gold)


add("gold_match_rates", _gold, "select 12::bigint as n, 1.0::double as status_rate, 1.0::double as intent_rate, 1.0::double as metric_id_rate, 0.75::double as epoch_rate, 1.0::double as aoi_rate, 1.0::double as tools_rate, 0.75::double as all_fields_rate, 1.0::double as valid_rate")

# Learning.
_FEATS = ("b02", "b03", "b04", "b08", "b11", "b12", "ndvi", "ndbi", "mndwi", "bsi")
add("rf_features", lambda s, d: ml.feature_rows(s, d).select("row", "col", *_FEATS, "slope", "aspect_sin", "aspect_cos"), query(f"select \"row\", col, {', '.join(_FEATS)}, 0.0::double as slope, 0.0::double as aspect_sin, 0.0::double as aspect_cos from idx where epoch = 't2'", "idx"))
add("rf_training_sample", lambda s, d: ml.training_sample(ml.feature_rows(s, d), 60, 42).groupBy("class_id").agg(F.count("*").alias("n")), query("select class_id, least(count(*), 60)::bigint as n from cls where epoch = 't2' and class_id between 1 and 5 group by 1", "cls"))
add("rf_train_predict", lambda s, d: ml.train_and_predict(ml.feature_rows(s, d)))
add("rf_importance", lambda s, d: ml.importances(ml.feature_rows(s, d)))
add("rf_cross_validation", lambda s, d: ml.cross_validate(ml.feature_rows(s, d)))

# Streaming.
add("streaming_month_counts", months.counts_of_table, query("select strftime(datetime, '%Y-%m') as ym, count(*) as n from scenes group by 1", "scenes"))
add("streaming_best_scene", months.best_of_table, query("select id, tile, day from ranked where place = 1 and tile is not null", "ranked"))

# Configuration and manifest.
add("config_hash", lambda s, d: fx.table(s, d, "region").select("r_regionkey", F.substring(F.sha2(F.col("r_name"), 256), 1, 12).alias("hash")), "select r_regionkey, substr(sha256(r_name), 1, 12) as hash from region")
