"""Scene catalogues: tiles, deduplication with an audit, calendars and offset diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mgrs_tile() -> Column:
    """The tile property, else the first tile name in the id, else null."""
    return F.coalesce(F.nullif(F.col("mgrs"), F.lit("")), F.nullif(F.regexp_extract("id", "[0-9]{2}[A-Z]{3}", 0), F.lit("")))


def baseline_number() -> Column:
    return F.coalesce(F.col("baseline").try_cast("double"), F.lit(0.0))


def platform_rank() -> Column:
    name = F.lower("platform")
    return F.when(name == "sentinel-2a", 0).when(name == "sentinel-2b", 1).when(name == "sentinel-2c", 2).otherwise(3)


def ranked(scenes: DataFrame) -> DataFrame:
    """Scenes with tile, day, their place among those of one tile and day, and the kept one's id and baseline.

    Highest baseline first, then platform, then id. Scenes without a tile have no rivals.
    """
    keyed = scenes.withColumns({"tile": mgrs_tile(), "day": F.to_date("datetime"), "base_no": baseline_number(), "rank_no": platform_rank()})
    # Keyless scenes are windows of their own, so they neither compete nor share a partition.
    group = Window.partitionBy("tile", "day", F.when(F.col("tile").isNull() | F.col("day").isNull(), F.col("id"))).orderBy(F.desc("base_no"), "rank_no", "id")
    return keyed.withColumns({"place": F.row_number().over(group), "kept_id": F.first("id").over(group), "kept_base": F.first("base_no").over(group)})


def deduplicated(scenes: DataFrame) -> DataFrame:
    return ranked(scenes).filter("place = 1").select("id", "platform", "tile", "day", "base_no")


def drop_audit(scenes: DataFrame) -> DataFrame:
    reason = F.when(F.col("base_no") == F.col("kept_base"), "same-baseline platform/item tie-break").otherwise("lower processing baseline")
    return ranked(scenes).filter("place > 1").select("id", "kept_id", "tile", "day", reason.alias("reason"))


def metadata(scenes: DataFrame) -> DataFrame:
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return scenes.select(F.col("id").alias("scene_id"), F.col("datetime"), F.col("cloud").alias("cloud_cover_pct"), unknown(F.col("platform")).alias("platform"), unknown(mgrs_tile()).alias("mgrs_tile"), unknown(F.col("baseline")).alias("processing_baseline"))


def catalog_search(scenes: DataFrame, start: str, end: str, most_cloud: float | None, tiles: tuple[str, ...], cap: int = 500) -> DataFrame:
    """Scenes of a period and area with little cloud, the first `cap` by time and id."""
    found = scenes.withColumn("tile", mgrs_tile()).filter(F.to_date("datetime").between(start, end) & F.col("tile").isin(*tiles))
    if most_cloud is not None:
        found = found.filter(F.col("cloud") <= most_cloud)
    return found.orderBy("datetime", "id").limit(cap).select("id", "tile", "datetime", "cloud")


def epoch_of(day: Column, edge: int) -> Column:
    year = F.year(day)
    return F.when(year < edge, "t1").when(year > edge, "t2")


def epoch_months(scenes: DataFrame, edge: int) -> DataFrame:
    return scenes.select(epoch_of(F.col("datetime"), edge).alias("epoch"), F.month("datetime").alias("month"), "id", "datetime").filter("epoch is not null")


def matched_months(scenes: DataFrame, edge: int) -> DataFrame:
    """Calendar months that both epochs have."""
    m = epoch_months(scenes, edge)
    return m.filter("epoch = 't1'").select("month").intersect(m.filter("epoch = 't2'").select("month"))


def month_dropped(scenes: DataFrame, edge: int) -> DataFrame:
    """Scenes of months that only one epoch has."""
    return epoch_months(scenes, edge).join(F.broadcast(matched_months(scenes, edge)), "month", "left_anti").select("id", "epoch", "month", F.lit("calendar month absent from the other epoch").alias("reason"))


def monthly_counts(scenes: DataFrame, edge: int) -> DataFrame:
    return scenes.select(epoch_of(F.col("datetime"), edge).alias("epoch"), F.date_format("datetime", "yyyy-MM").alias("ym")).filter("epoch is not null").groupBy("epoch", "ym").agg(F.count("*").alias("n"))


def count_check(scenes: DataFrame, edge: int, expected: dict[str, int]) -> DataFrame:
    want = F.create_map(*[F.lit(v) for kv in expected.items() for v in kv])
    out = epoch_months(scenes, edge).groupBy("epoch").agg(F.count("*").alias("n"))
    return out.withColumn("expected", want[F.col("epoch")].cast("long")).withColumn("matches", F.col("n") == F.col("expected"))


def summary(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.round(F.min("cloud"), 6).alias("cloud_min"), F.round(F.max("cloud"), 6).alias("cloud_max"), F.round(F.avg("cloud"), 6).alias("cloud_mean"), F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"))


def same_day_pairs(scenes: DataFrame) -> DataFrame:
    """Unordered pairs of one tile and day that differ in their flag or baseline; days hold few scenes."""
    s = scenes.withColumns({"tile": mgrs_tile(), "day": F.to_date("datetime")}).select("tile", "day", "id", "baseline", "boa_flag")
    a, b = (s.select("tile", "day", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "baseline", "boa_flag")]) for x in "ab")
    return a.join(b, ["tile", "day"]).filter("id_a < id_b").withColumn("flags_differ", ~F.col("boa_flag_a").eqNullSafe(F.col("boa_flag_b"))).select("tile", "day", "id_a", "id_b", "flags_differ")


def baseline_pair(scenes: DataFrame, low: str = "00.01", high: str = "05.00") -> DataFrame:
    """The first tile and day that has scenes of both baselines, with the smallest id of each."""
    s = scenes.withColumns({"tile": mgrs_tile(), "day": F.to_date("datetime")}).filter("tile is not null")
    pairs = s.groupBy("tile", "day").agg(F.min(F.when(F.col("baseline") == low, F.col("id"))).alias("low_id"), F.min(F.when(F.col("baseline") == high, F.col("id"))).alias("high_id"))
    return pairs.filter("low_id is not null and high_id is not null").orderBy("tile", "day").limit(1)


def offset_flag_steps(obs: DataFrame) -> DataFrame:
    """For each epoch and band the step of medians without and with the flag, and whether it is about 0.1."""
    med = obs.groupBy("epoch", "band").agg(F.median(F.when(~F.col("flag"), F.col("v"))).alias("without"), F.median(F.when(F.col("flag"), F.col("v"))).alias("with_flag"))
    step = F.col("without") - F.col("with_flag")
    return med.select("epoch", "band", F.round(step, 9).alias("step"), F.abs(step).between(0.07, 0.13).alias("about_tenth"))


def offset_outliers(obs: DataFrame, limit: float = 0.03) -> DataFrame:
    """Scenes whose median in a band is more than `limit` from the epoch's median of scene medians."""
    scene = obs.groupBy("epoch", "band", "scene").agg(F.median("v").alias("scene_median"))
    epoch = scene.groupBy("epoch", "band").agg(F.median("scene_median").alias("epoch_median"))
    out = scene.join(F.broadcast(epoch), ["epoch", "band"]).withColumn("delta", F.round(F.col("scene_median") - F.col("epoch_median"), 9))
    return out.filter(F.abs("delta") > limit).select("epoch", "band", "scene", "delta")
