"""The registered queries of the land-change engine, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import accuracy, assoc, change, focal, raster, sampling, scenes
from groundshift.plans.oracle import query
from groundshift.session import ship_package
from groundshift.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EDGE_YEAR = 1998


def registered(name: str, oracle: str | None = None):
    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return wrap


def add(name: str, f: Query, oracle: str | None = None) -> None:
    registered(name, oracle)(f)


# Masks and composites.
add("scl_valid_mask", lambda s, d: fx.px_obs(s, d).select("scene_id", raster.scl_valid(F.col("scl")).alias("valid")), query("select scene_id, coalesce(scl not in (0,1,2,3,8,9,10,11), false) as valid from px", "px"))
add("masked_stack", lambda s, d: raster.mask_stack(fx.px_obs(s, d)).select("scene_id", "valid", *raster.BANDS), query("select scene_id, valid, b02, b03, b04, b08, b11, b12 from masked", "masked"))
add("valid_fraction", lambda s, d: raster.valid_fraction(raster.mask_stack(fx.px_obs(s, d))), query('select epoch, "row", col, cast(avg(valid::int::double) as float) as valid_frac from masked group by 1, 2, 3', "masked"))
add("coverage_check", lambda s, d: raster.coverage(raster.valid_fraction(raster.mask_stack(fx.px_obs(s, d)))).withColumn("mean_frac", F.round("mean_frac", 9)), query('select epoch, round(avg(f::double), 9) as mean_frac, min(f) as min_frac, avg(f::double) >= 0.7e0 as ok, min(f)::double < 0.3e0 as warned from (select epoch, cast(avg(valid::int::double) as float) as f from masked group by epoch, "row", col) group by epoch', "masked"))
_COEF = "select id, datetime, baseline, case when boa_present and abs(\"offset\" + 0.1e0) <= 1.1e-6 then 0.0e0 when not (boa_present and coalesce(boa_flag, false)) and coalesce(try_cast(baseline as double), 0) >= 4 and strftime(datetime, '%Y-%m-%d') >= '1998-01-25' and abs(\"offset\") <= 1e-8 then -0.1e0 else \"offset\" end as effective from scenes"


def _offset(df: DataFrame) -> DataFrame:
    # The test scenes are older than the real cut-over day, so the day moves with them.
    day = F.when(F.date_format("datetime", "yyyy-MM-dd") >= "1998-01-25", "2022-01-25").otherwise("2019-01-01")
    return df.withColumn("effective", raster.reflectance_offset(F.col("offset"), F.col("baseline"), day, F.col("boa_present"), F.col("boa_flag")))


add("reflectance_scale_offset", lambda s, d: _offset(fx.scenes(s, d)).select("id", "baseline", F.lit(0.0001).alias("scale"), (F.col("effective") + F.lit(0.0)).alias("effective")), query(f"select id, baseline, 0.0001e0 as scale, effective from ({_COEF})", "scenes"))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    coef = _offset(fx.scenes(s, d)).select(F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("okey"), F.lit(0.0001).alias("scale"), F.col("effective").alias("offset"))
    px = fx.px_obs(s, d).withColumn("okey", F.split("scene_id", "-")[0].cast("long")).withColumns({b: (F.col(b).cast("double") * 10000).cast("float") for b in raster.BANDS})
    return raster.normalize_reflectance(px.withColumnRenamed("scene_id", "obs_id").withColumnRenamed("okey", "scene_id"), coef.withColumnRenamed("okey", "scene_id")).select(F.col("obs_id").alias("scene_id"), "scl", *raster.BANDS)


add("normalize_reflectance", _normalized, query("select scene_id, scl, " + ", ".join(f"cast(cast({b}::double * 10000 as float)::double * 0.0001e0 + effective as float) as {b}" for b in raster.BANDS) + f" from px join ({_COEF}) c on cast(regexp_extract(c.id, '([0-9]+)$', 1) as bigint) = cast(split_part(scene_id, '-', 1) as bigint)", "px", "scenes"))
add("median_composite", fx.composite, query('select epoch, "row", col, b02, b03, b04, b08, b11, b12 from comp', "comp"))
_MONTHLY = 'select epoch, "row", col, ' + ", ".join(f"cast(median(cast({b} as double)) as float) as {b}" for b in raster.BANDS)
add("month_balanced_composite", lambda s, d: raster.month_balanced_composite(raster.mask_stack(fx.px_obs(s, d)).filter("epoch is not null")), query(f'{_MONTHLY} from ({_MONTHLY}, month(ts) as m from masked where epoch is not null group by epoch, "row", col, month(ts)) group by epoch, "row", col', "masked"))
for _i in raster.INDICES:
    add(_i, lambda s, d, i=_i: raster.indices(fx.composite(s, d)).select("epoch", "row", "col", i), query(f'select epoch, "row", col, {_i} from idx', "idx"))
add("all_indices", lambda s, d: raster.indices(fx.composite(s, d)).select("epoch", "row", "col", *raster.INDICES), query('select epoch, "row", col, ndvi, ndbi, mndwi, bsi from idx', "idx"))
add("ndvi_delta_eps", lambda s, d: (lambda c: c.filter("epoch = 't1'").select("row", "col", F.col("e").alias("e1")).join(c.filter("epoch = 't2'").select("row", "col", F.col("e").alias("e2")), ["row", "col"]).select("row", "col", (F.col("e2") - F.col("e1")).alias("delta")))(fx.composite(s, d).withColumn("e", raster.ndvi_epsilon(F.col("b08"), F.col("b04")))), query('select "row", col, b.e - a.e as delta from (select "row", col, case when abs((b08 + b04)::double) > 1e-8 then cast((b08 - b04) / (b08 + b04) as float) end as e from comp where epoch = \'t1\') a join (select "row", col, case when abs((b08 + b04)::double) > 1e-8 then cast((b08 - b04) / (b08 + b04) as float) end as e from comp where epoch = \'t2\') b using ("row", col)', "comp"))
add("rule_classify", fx.lulc, query('select epoch, "row", col, class_id from lulc', "lulc"))
add("class_histogram", lambda s, d: fx.lulc(s, d).groupBy("epoch", "class_id").agg(F.count("*").alias("n")), query("select epoch, class_id, count(*) as n from lulc group by 1, 2", "lulc"))
_LONG = "(select epoch, unnest(['b02', 'b03', 'b04', 'b08', 'b11', 'b12']) as band, unnest([b02, b03, b04, b08, b11, b12]) as v from comp)"
add("band_stats", lambda s, d: raster.band_stats(fx.composite(s, d)), query(f"select epoch, band, count(v) as n, min(v) as min_v, round(avg(v::double), 9) as mean_v, max(v) as max_v from {_LONG} group by 1, 2", "comp"))
add("band_stats_median", lambda s, d: raster.band_stats(fx.composite(s, d), True).select("epoch", "band", F.col("median_v").cast("double").alias("median_v")), query(f"select epoch, band, median(v::double) as median_v from {_LONG} group by 1, 2", "comp"))
add("percentile_stretch", lambda s, d: raster.percentile_stretch(fx.composite(s, d).filter("epoch = 't2'").select("row", "col", F.col("b04").cast("double").alias("b04")), "b04").select("row", "col", F.round("stretched", 6).alias("stretched")), query("select \"row\", col, round(case when b04 is not null then greatest(0.0e0, least(1.0e0, (b04::double - lo) / (hi - lo))) end, 6) as stretched from comp, (select quantile_cont(b04::double, 0.02) as lo, quantile_cont(b04::double, 0.98) as hi from comp where epoch = 't2') where epoch = 't2'", "comp"))

# Change.
add("transition_matrix", lambda s, d: change.transition_matrix(fx.class_pair(s, d)), query("select c1, c2, pixels, round(pixels * 100.0e0 / 1e6, 4) as area_km2 from trans", "trans"))
add("transition_pivot", lambda s, d: change.transition_pivot(fx.class_pair(s, d)), query("select c1, " + ", ".join(f"cast(sum(case when c2 = {c} then pixels else 0 end) as bigint) as to_{c}" for c in range(1, 6)) + " from trans group by c1", "trans"))
add("class_stats", lambda s, d: change.class_stats(fx.class_pair(s, d)), query("select class_id, round(n1 * 100.0e0 / 1e6, 4) as t1_km2, round(n2 * 100.0e0 / 1e6, 4) as t2_km2, round(n2 * 100.0e0 / 1e6 - n1 * 100.0e0 / 1e6, 4) as net_km2, round(coalesce((n2 * 100.0e0 / 1e6 - n1 * 100.0e0 / 1e6) / nullif(n1 * 100.0e0 / 1e6, 0) * 100, 0.0e0), 2) as pct_change from (select c1 as class_id, sum(pixels) as n1 from trans group by 1) join (select c2 as class_id, sum(pixels) as n2 from trans group by 1) using (class_id)", "trans"))
add("key_transitions", lambda s, d: change.key_transitions(fx.class_pair(s, d)), query("select " + ", ".join(f"round(sum(case when {c} then pixels else 0 end) * 100.0e0 / 1e6, 4) as {n}" for n, c in (("vegetation_to_built_km2", "c1 in (2,3) and c2 = 1"), ("soil_to_built_km2", "c1 = 4 and c2 = 1"), ("vegetation_loss_km2", "c1 in (2,3) and c2 not in (2,3)"), ("urban_gain_km2", "c1 <> 1 and c2 = 1"))) + " from trans", "trans"))
add("footprint_stats", lambda s, d: change.footprint(fx.class_pair(s, d)), query("select a as footprint_px, v as valid_px, a - v as excluded_px, round(a * 100.0e0 / 1e6, 4) as footprint_km2, round(v * 100.0e0 / 1e6, 4) as valid_km2, round((a - v) * 100.0e0 / 1e6, 4) as excluded_km2, round((a - v) * 100.0e0 / a, 2) as excluded_pct from (select count(*) as a, count(*) filter (c1 between 1 and 5 and c2 between 1 and 5) as v from pairs)", "pairs"))
add("change_masks", lambda s, d: change.change_masks(fx.class_pair(s, d)), query('select "row", col, urban, veg_loss, water_change, unchanged from masks', "masks"))
add("mask_encoding", lambda s, d: change.change_masks(fx.class_pair(s, d)).select("row", "col", change.encode_mask(F.col("urban")).alias("urban")), query('select "row", col, coalesce(urban, 255) as urban from masks', "masks"))
_E = "(select \"row\", col, ndvi as {1} from idx where epoch = '{0}')"


def _epochs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = raster.indices(fx.composite(s, d))
    return i.filter("epoch = 't1'"), i.filter("epoch = 't2'")


add("ndvi_decline", lambda s, d: change.ndvi_decline(*_epochs(s, d)), query(f"select \"row\", col, n2 - n1 as delta, cast(n2 - n1 < cast(-0.15 as float) as int) as declined from {_E.format('t1', 'n1')} join {_E.format('t2', 'n2')} using (\"row\", col)", "idx"))
add("epoch_mean_difference", lambda s, d: change.mean_difference(*_epochs(s, d), "ndvi"), query(f"select count(*) as n, round(avg(n1::double), 9) as mean_a, round(avg(n2::double), 9) as mean_b, round(avg(n2::double - n1::double), 9) as mean_diff from {_E.format('t1', 'n1')} join {_E.format('t2', 'n2')} using (\"row\", col) where n1 is not null and n2 is not null", "idx"))


def _external(s: SparkSession, d: str) -> DataFrame:
    return change.change_masks(fx.class_pair(s, d)).join(fx.external(s), ["row", "col"])


_OVER = "select count(*) as valid_px, count(*) filter ({m}) as mapped_px, count(*) filter ({o}) as external_px, count(*) filter ({m} and {o}) as common_px, count(*) filter ({m} and {o})::double / nullif(count(*) filter ({m} or {o}), 0) as iou, count(*) filter ({m} and {o})::double / nullif(count(*) filter ({m}), 0) as mapped_share, count(*) filter ({m} and {o})::double / nullif(count(*) filter ({o}), 0) as external_share from masks join ext using (\"row\", col) where {v}"
add("overlap_iou", lambda s, d: change.overlap_stats(_external(s, d), F.col("urban") == 1, F.col("built"), F.col("urban").isNotNull()), query(_OVER.format(m="urban = 1", o="built", v="urban is not null"), "masks", "ext"))
add("loss_year_range", lambda s, d: change.overlap_stats(_external(s, d), F.col("veg_loss") == 1, change.forest_loss(F.col("lossyear"), F.col("treecover"), F.col("datamask"), 19, 24), F.col("veg_loss").isNotNull() & F.col("datamask")), query(_OVER.format(m="veg_loss = 1", o="(lossyear between 19 and 24 and treecover >= 30 and datamask)", v="veg_loss is not null and datamask"), "masks", "ext"))
add("gain_predicate", lambda s, d: fx.external(s).select("row", "col", change.built_gain(F.col("lossyear") % 3, F.col("treecover") % 4).alias("gain")), query('select "row", col, lossyear % 3 = 0 and treecover % 4 > 0 as gain from ext', "ext"))
add("cover_codes", lambda s, d: _external(s, d).select("row", "col", (F.col("lossyear") * 2 == 50).alias("is_built"), (F.col("lossyear") * 2 == 10).alias("is_tree")), query('select "row", col, lossyear * 2 = 50 as is_built, lossyear * 2 = 10 as is_tree from ext', "ext"))

# Scenes.
add("scene_dedup", lambda s, d: scenes.deduplicated(fx.scenes(s, d)), query("select id, platform, tile, day, base_no from ranked where place = 1", "ranked"))
add("scene_drop_audit", lambda s, d: scenes.drop_audit(fx.scenes(s, d)), query("select id, kept_id, tile, day, case when base_no = kept_base then 'same-baseline platform/item tie-break' else 'lower processing baseline' end as reason from ranked where place > 1", "ranked"))
add("scene_metadata", lambda s, d: scenes.metadata(fx.scenes(s, d)), query("select id as scene_id, datetime, cloud as cloud_cover_pct, coalesce(platform, 'unknown') as platform, coalesce(tile, 'unknown') as mgrs_tile, coalesce(baseline, 'unknown') as processing_baseline from tiled", "tiled"))
add("mgrs_tile", lambda s, d: fx.scenes(s, d).select("id", scenes.mgrs_tile().alias("tile")), query("select id, tile from tiled", "tiled"))
add("catalog_search", lambda s, d: scenes.catalog_search(fx.scenes(s, d), "1996-11-01", "1997-03-31", 20.0, ("44RKU", "44RLU")), query("select id, tile, datetime, cloud from tiled where day between date '1996-11-01' and date '1997-03-31' and tile in ('44RKU', '44RLU') and cloud <= 20 order by datetime, id limit 500", "tiled"))
add("month_intersection", lambda s, d: scenes.matched_months(fx.scenes(s, d), EDGE_YEAR).select(F.col("month").cast("long").alias("month")), query("select month from epochs where epoch = 't1' intersect select month from epochs where epoch = 't2'", "epochs"))
add("month_dropped", lambda s, d: scenes.month_dropped(fx.scenes(s, d).filter(~((F.year("datetime") > EDGE_YEAR) & F.month("datetime").isin(6, 7))), EDGE_YEAR).withColumn("month", F.col("month").cast("long")), query("select id, epoch, month, 'calendar month absent from the other epoch' as reason from epochs where not (epoch = 't2' and month in (6, 7)) and month not in (select month from epochs where epoch = 't1' intersect select month from epochs where epoch = 't2' and month not in (6, 7))", "epochs"))
add("monthly_counts", lambda s, d: scenes.monthly_counts(fx.scenes(s, d), EDGE_YEAR), query("select epoch, strftime(datetime, '%Y-%m') as ym, count(*) as n from epochs group by 1, 2", "epochs"))
add("scene_count_check", lambda s, d: scenes.count_check(fx.scenes(s, d), EDGE_YEAR, {"t1": 36, "t2": 46}), query("select epoch, count(*) as n, case epoch when 't1' then 36 else 46 end::bigint as expected, count(*) = case epoch when 't1' then 36 else 46 end as matches from epochs group by 1", "epochs"))
add("scene_summary", lambda s, d: scenes.summary(fx.scenes(s, d)), query("select count(*) as n, min(datetime) as first, max(datetime) as last, round(min(cloud), 6) as cloud_min, round(max(cloud), 6) as cloud_max, round(avg(cloud), 6) as cloud_mean, string_agg(distinct platform, ',' order by platform) as platforms from scenes", "scenes"))
add("same_day_pairs", lambda s, d: scenes.same_day_pairs(fx.scenes(s, d)), query("select a.tile, a.day, a.id as id_a, b.id as id_b, a.boa_flag is distinct from b.boa_flag as flags_differ from tiled a join tiled b on a.tile = b.tile and a.day = b.day and a.id < b.id", "tiled"))
add("baseline_pair", lambda s, d: scenes.baseline_pair(fx.scenes(s, d)), query("select tile, day, min(id) filter (baseline = '00.01') as low_id, min(id) filter (baseline = '05.00') as high_id from tiled where tile is not null group by 1, 2 having low_id is not null and high_id is not null order by 1, 2 limit 1", "tiled"))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    key = F.split("scene_id", "-")[0].cast("long")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in ("b02", "b03", "b04")])
    return fx.px_obs(s, d).filter("epoch is not null").select("epoch", (key % 50).alias("scene"), (key % 2 == 0).alias("flag"), F.explode(bands).alias("x")).select("epoch", "scene", "flag", "x.band", F.col("x.v").cast("double").alias("v"))


add("offset_flag_steps", lambda s, d: scenes.offset_flag_steps(_flagged(s, d)), query("select epoch, band, round(a - b, 9) as step, abs(a - b) between 0.07e0 and 0.13e0 as about_tenth from (select epoch, band, median(v::double) filter (not flag) as a, median(v::double) filter (flag) as b from flagged group by 1, 2)", "flagged"))
add("offset_outliers", lambda s, d: scenes.offset_outliers(_flagged(s, d)), query("with sm as (select epoch, band, scene, median(v::double) as m from flagged group by 1, 2, 3), em as (select epoch, band, median(m) as e from sm group by 1, 2) select epoch, band, scene, round(m - e, 9) as delta from sm join em using (epoch, band) where abs(round(m - e, 9)) > 0.03e0", "flagged").replace(" with sm as", ", sm as"))

# Terrain and neighbourhoods.
add("slope_aspect", lambda s, d: focal.slope_aspect(fx.dem(s)).select("row", "col", F.round("slope", 9).alias("slope"), F.round("aspect", 6).alias("aspect")), query('select "row", col, round(degrees(atan(sqrt(dz_dx * dz_dx + dz_dy * dz_dy))), 9) as slope, round(((degrees(atan2(-dz_dx, dz_dy)) % 360) + 360) % 360, 6) as aspect from grad', "grad"))
add("terrain_encoding", lambda s, d: focal.aspect_encoding(focal.slope_aspect(fx.dem(s))).select("row", "col", (F.round("aspect_sin", 9) + F.lit(0.0)).alias("aspect_sin"), (F.round("aspect_cos", 9) + F.lit(0.0)).alias("aspect_cos")), query('select "row", col, round(sin(atan2(-dz_dx, dz_dy)), 9) + 0.0e0 as aspect_sin, round(cos(atan2(-dz_dx, dz_dy)), 9) + 0.0e0 as aspect_cos from grad', "grad"))
_MAJ = """select "row", col, case when centre = 0 then 0 else vote end as class_id from (select s."row", s.col, s.class_id as centre, n.class_id as vote, row_number() over (partition by s."row", s.col order by count(n.class_id) desc, (n.class_id = s.class_id) desc, n.class_id) as k
 from {src} s left join {src} n on n.class_id <> 0 and abs(n."row" - s."row") <= 1 and abs(n.col - s.col) <= 1 group by s."row", s.col, s.class_id, n.class_id) where k = 1"""
_LAB = """reach as (select "row", col, class_id, "row" * 40 + col as lab from {src} where class_id <> 0 union select b."row", b.col, b.class_id, r.lab from reach r join {src} b on b.class_id = r.class_id and abs(b."row" - r."row") + abs(b.col - r.col) = 1),
 lab as (select "row", col, class_id, min(lab) as lab from reach group by 1, 2, 3), big as (select lab from lab group by 1 having count(*) >= {least})"""
_SIEVED = 'select s."row", s.col, case when l.lab in (select lab from big) then s.class_id else 0 end as class_id from {src} s left join lab l on l."row" = s."row" and l.col = s.col'
_T2 = lambda s, d: fx.lulc(s, d).filter("epoch = 't2'").select("row", "col", "class_id")
add("majority_filter", lambda s, d: focal.majority_filter(_T2(s, d)), query(_MAJ.format(src="t2"), "t2"))
add("mmu_sieve", lambda s, d: focal.remove_small_patches(_T2(s, d), 0.05), query("@" + _SIEVED.format(src="t2"), "t2").replace(" @", ", " + _LAB.format(src="t2", least=5) + " "))
add("postprocess", lambda s, d: focal.postprocess(_T2(s, d), 3, 0.05), query("@" + _SIEVED.format(src="maj"), "t2").replace(" @", f", maj as ({_MAJ.format(src='t2')}), " + _LAB.format(src="maj", least=5) + " "))
add("regrid_nearest", lambda s, d: focal.regrid_nearest(fx.dem(s), s.range(400).select((F.floor(F.col("id") / 20)).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col")), "elevation", 2.0, 2.0), query('select cast(i // 20 as int) as "row", cast(i % 20 as int) as col, elevation from range(400) t(i) left join dem d on d."row" = (i // 20) * 2 + 1 and d.col = (i % 20) * 2 + 1', "dem"))
add("regrid_bilinear", lambda s, d: focal.regrid_bilinear(fx.dem(s), s.range(900).select((F.floor(F.col("id") / 30)).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col")), "elevation", 1.25, 1.25).withColumn("elevation", F.round("elevation", 6)), query('@select r as "row", c as col, round(sum(w * elevation) / sum(w), 6) as elevation from (select r, c, d.elevation, (case when dy = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when dx = 1 then x - floor(x) else 1 - (x - floor(x)) end) as w from tg, (values (0), (1)) a(dy), (values (0), (1)) b(dx), dem d where d."row" = floor(y)::int + dy and d.col = floor(x)::int + dx) group by 1, 2', "dem").replace(" @", ", tg as (select cast(i // 30 as int) as r, cast(i % 30 as int) as c, (i // 30 + 0.5e0) * 1.25e0 - 0.5e0 as y, (i % 30 + 0.5e0) * 1.25e0 - 0.5e0 as x from range(900) t(i)) "))

# Grid association.
_GRID = lambda s, d: assoc.grid_aggregate(change.change_masks(fx.class_pair(s, d)), 4, 10)
add("grid_aggregate", _GRID, query("select cell_id, row_idx, col_idx, gain_ha, loss_ha, overlap_ha, valid_frac from grid", "grid"))
add("queen_edges", lambda s, d: assoc.queen_edges(_GRID(s, d)), query("select src, dst from edges", "edges"))
for _v in ("loss_ha", "gain_ha"):
    add("morans_i" if _v == "loss_ha" else "morans_i_gain", lambda s, d, v=_v: assoc.morans_i(_GRID(s, d), assoc.queen_edges(_GRID(s, d)), v), query(f"select (select count(*) from grid) as n, (select count(*) from edges) as s0, round((select count(*) from grid) / (select count(*) from edges)::double * (select sum((a.{_v} - m) * (b.{_v} - m)) from edges e join grid a on a.cell_id = e.src join grid b on b.cell_id = e.dst) / (select sum(({_v} - m) * ({_v} - m)) from grid), 9) as morans_i from (select avg({_v}) as m from grid)", "grid", "edges"))
add("morans_permutation", lambda s, d: assoc.morans_permutation(_GRID(s, d), assoc.queen_edges(_GRID(s, d)), "loss_ha"))
_GI = lambda s, d: assoc.gi_star(_GRID(s, d), assoc.queen_edges(_GRID(s, d)), "loss_ha")
add("gi_star", _GI, query("select cell_id, loss_ha, round(z, 9) as z, significant from gi", "gi"))
_TOP = "select cell_id, loss_ha, round(z, 9) as z, significant, row_number() over (order by round(z, 9) desc, cell_id desc) as hot_rank from gi where significant qualify hot_rank <= 20"
add("hotspots_topn", lambda s, d: assoc.hotspots(_GI(s, d)).withColumn("hot_rank", F.col("hot_rank").cast("long")), query(_TOP, "gi"))
add("hotspot_rank", lambda s, d: assoc.hotspot_rank(_GI(s, d)).withColumn("hot_rank", F.col("hot_rank").cast("long")), query(f"select cell_id, round(gi.z, 9) as z, t.hot_rank from gi left join ({_TOP}) t using (cell_id)", "gi"))
_RANKS = "(select rank() over (order by gain_ha) + (count(*) over (partition by gain_ha) - 1) / 2.0e0 as ra, rank() over (order by loss_ha) + (count(*) over (partition by loss_ha) - 1) / 2.0e0 as rb from grid)"
add("spearman", lambda s, d: assoc.spearman(_GRID(s, d), "gain_ha", "loss_ha"), query(f"select count(*) as n, round(corr(ra, rb), 9) as rho from {_RANKS}", "grid"))
add("spearman_p", lambda s, d: assoc.spearman_p(assoc.spearman(_GRID(s, d), "gain_ha", "loss_ha")))

# Sampling and accuracy.
_KEY = '("row" * 7919 + col * 104729 + {seed} * 15485863) % 1000003'
add("stratified_sample", lambda s, d: sampling.stratified_sample(_T2(s, d), 25, 42), query(f'select "row", col, class_id from (select *, row_number() over (partition by class_id order by {_KEY.format(seed=42)}, "row", col) as k from t2 where class_id between 1 and 5) where k <= 25', "t2"))
_CAND = "select candidate_epoch, \"row\", col, stratum, c1 as pred_t1, c2 as pred_t2, 'candidate-' || lpad(cast(row_number() over (order by candidate_epoch, stratum, \"row\", col) as varchar), 7, '0') as id from (" + " union all ".join(f"select 't{e}' as candidate_epoch, \"row\", col, c{e} as stratum, c1, c2, row_number() over (partition by c{e} order by {_KEY.format(seed=41 + e)}, \"row\", col) as k from pairs where c{e} between 1 and 5" for e in (1, 2)) + ") where k <= 25"
add("candidate_records", lambda s, d: sampling.candidate_records(fx.class_pair(s, d), 25, 42), query(_CAND, "pairs"))
add("candidate_counts", lambda s, d: sampling.candidate_counts(sampling.candidate_records(fx.class_pair(s, d), 25, 42)), query(f"select candidate_epoch, stratum, count(*) as n from ({_CAND}) group by 1, 2", "pairs"))
add("kfold", lambda s, d: sampling.kfold(_T2(s, d), 5, 42).withColumn("fold", F.col("fold").cast("long")), query(f'select "row", col, class_id, (row_number() over (partition by class_id order by {_KEY.format(seed=42)}, "row", col) - 1) % 5 as fold from t2', "t2"))
add("block_holdout", lambda s, d: sampling.block_holdout(fx.labels_ref(s, d), 5000.0, 0.2, 42).select("id", "block", "is_test"), query("select id, block, is_test from (select id, floor(x / 5000)::bigint as bx, floor(y / 5000)::bigint as \"by\", floor(x / 5000)::bigint || ':' || floor(y / 5000)::bigint as block from labels_ref) join (select block, row_number() over (order by (bx * 7919 + \"by\" * 104729 + 42 * 15485863) % 1000003, bx, \"by\") <= ceil(count(*) over () * 0.2e0) as is_test from (select distinct floor(x / 5000)::bigint as bx, floor(y / 5000)::bigint as \"by\", floor(x / 5000)::bigint || ':' || floor(y / 5000)::bigint as block from labels_ref)) using (block)", "labels_ref"))
add("class_weights", lambda s, d: sampling.class_weights(_T2(s, d)), query("select class_id, count(*) as n_c, round((sum(count(*)) over ())::double / (count(*) over () * count(*)), 9) as weight from t2 group by 1", "t2"))
_CONF = lambda s, d: accuracy.confusion(fx.labels_ref(s, d), "class_b", "class_a")
add("confusion_matrix", _CONF, query("select truth, predicted, n from conf", "conf"))
_F1 = 'coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0)'
add("accuracy_report", lambda s, d: accuracy.class_report(_CONF(s, d)), query(f'select class_id, round("precision", 9) as "precision", round(recall, 9) as recall, round({_F1}, 9) as f1, cast(support as bigint) as support from report', "report"))
add("accuracy_averages", lambda s, d: accuracy.averages(accuracy.class_report(_CONF(s, d))), query('select round(avg(p), 6) as macro_precision, round(sum(p * support) / sum(support), 6) as weighted_precision, round(avg(r), 6) as macro_recall, round(sum(r * support) / sum(support), 6) as weighted_recall, round(avg(f), 6) as macro_f1, round(sum(f * support) / sum(support), 6) as weighted_f1 from (select round("precision", 9) as p, round(recall, 9) as r, round(' + _F1 + ", 9) as f, support from report)", "report"))
_KAPPA = "select cast(n as bigint) as {name}, round(po, 9) as overall_accuracy, round((po - pe) / nullif(1 - pe, 0), 9) as kappa from (select sum(n) as n, sum(case when truth = predicted then n else 0 end)::double / sum(n) as po, (select sum(a.s::double * b.s) from (select truth as k, sum(n) as s from conf group by 1) a join (select predicted as k, sum(n) as s from conf group by 1) b using (k)) / (sum(n)::double * sum(n)) as pe from conf)"
add("kappa", lambda s, d: accuracy.kappa(_CONF(s, d)), query(_KAPPA.format(name="n"), "conf"))


def _two_labellers(s: SparkSession, d: str) -> DataFrame:
    refs = fx.labels_ref(s, d)
    sides = F.explode(F.array(F.struct(F.lit("A").alias("who"), F.col("class_b").alias("cls")), F.struct(F.lit("B").alias("who"), F.col("class_a").alias("cls"))))
    return refs.select("id", sides.alias("l")).select("id", "l.who", "l.cls")


add("interrater_kappa", lambda s, d: accuracy.interrater(_two_labellers(s, d), "id", "who", "cls", "A", "B"), query(_KAPPA.format(name="paired"), "conf"))
add("label_warnings", lambda s, d: accuracy.label_warnings(fx.labels_ref(s, d), "class_a"), query("select 'Class ' || class_a || ' has ' || n || ' labels, fewer than 30' as warning from (select class_a, count(*) as n from labels_ref where class_a between 1 and 5 group by 1) where n < 30 union all select 'Only ' || n || ' labels, fewer than 30' from (select count(*) as n from labels_ref where class_a between 1 and 5) where n < 30", "labels_ref"))
_COUNTS = "(select class_a as stratum, class_b as class_id, count(*)::double as n from labels_ref where class_a between 1 and 5 and class_b between 1 and 5 group by 1, 2)"


def _adjusted(s: SparkSession, d: str) -> DataFrame:
    strata = fx.labels_ref(s, d).filter("class_a between 1 and 5 and class_b between 1 and 5")
    counts = strata.groupBy(F.col("class_a").alias("stratum"), F.col("class_b").alias("class_id")).agg(F.count("*").alias("n"))
    areas = _T2(s, d).filter("class_id between 1 and 5").groupBy(F.col("class_id").alias("stratum")).agg((F.count("*") * 0.01).alias("area"))
    return accuracy.area_adjusted(areas.join(counts.select("stratum").distinct(), "stratum", "left_semi"), counts)


add("area_adjusted", _adjusted, query(f"select class_id, round(share * total, 6) as area, round(greatest(0.0e0, share * total - 1.96e0 * sqrt(v) * total), 6) as low, round(least(total, share * total + 1.96e0 * sqrt(v) * total), 6) as high from (select class_id, any_value(total) as total, sum(w * n / n_h) as share, sum(case when n_h > 1 then w * w * (n / n_h) * (1 - n / n_h) / (n_h - 1) else 0 end) as v from (select c.class_id, c.n, h.n_h, a.area / t.total as w, t.total from {_COUNTS} c join (select stratum, sum(n) as n_h from {_COUNTS} group by 1) h using (stratum) join (select class_id as stratum, count(*) * 0.01e0 as area from t2 where class_id between 1 and 5 group by 1) a using (stratum), (select sum(area) as total from (select class_id as stratum, count(*) * 0.01e0 as area from t2 where class_id between 1 and 5 group by 1) where stratum in (select stratum from {_COUNTS})) t) group by class_id)", "labels_ref", "t2"))
