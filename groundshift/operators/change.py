"""Two-epoch change: transition matrix, class balances, masks and comparison with external rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS_IDS = (1, 2, 3, 4, 5)
VEGETATION = (2, 3)


def both_valid() -> Column:
    return F.coalesce(F.col("c1").between(1, 5) & F.col("c2").between(1, 5), F.lit(False))


def class_frame(spark: SparkSession) -> DataFrame:
    """The 25 pairs of classes."""
    pairs = spark.range(25)
    return pairs.select(F.floor(F.col("id") / 5 + 1).cast("int").alias("c1"), (F.col("id") % 5 + 1).cast("int").alias("c2"))


def transition_counts(pairs: DataFrame) -> DataFrame:
    """c1, c2, pixels for all 25 pairs, zero where none."""
    counted = pairs.filter(both_valid()).groupBy("c1", "c2").agg(F.count("*").alias("pixels"))
    return class_frame(pairs.sparkSession).join(F.broadcast(counted), ["c1", "c2"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0).cast("long")))


def km2(pixels: Column, pixel_m: float = 10.0) -> Column:
    return F.round(pixels * F.lit(pixel_m * pixel_m) / F.lit(1e6), 4)


def transition_matrix(pairs: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    return transition_counts(pairs).withColumn("area_km2", km2(F.col("pixels"), pixel_m))


def transition_pivot(pairs: DataFrame) -> DataFrame:
    """One row for each first class, one column for each second class."""
    sums = [F.sum(F.when(F.col("c2") == c, F.col("pixels")).otherwise(0)).alias(f"to_{c}") for c in CLASS_IDS]
    return transition_counts(pairs).groupBy("c1").agg(*sums)


def class_stats(pairs: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    """Area at both epochs, net change and its percentage (0.0 from nothing) of each class."""
    counts = transition_counts(pairs)
    first = counts.groupBy(F.col("c1").alias("class_id")).agg(F.sum("pixels").alias("n1"))
    second = counts.groupBy(F.col("c2").alias("class_id")).agg(F.sum("pixels").alias("n2"))
    area = lambda c: F.col(c) * F.lit(pixel_m * pixel_m) / F.lit(1e6)
    return first.join(second, "class_id").select(
        "class_id", F.round(area("n1"), 4).alias("t1_km2"), F.round(area("n2"), 4).alias("t2_km2"), F.round(area("n2") - area("n1"), 4).alias("net_km2"),
        F.round(F.coalesce(F.try_divide(area("n2") - area("n1"), area("n1")) * 100, F.lit(0.0)), 2).alias("pct_change"),
    )


def key_transitions(pairs: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    c1, c2 = F.col("c1"), F.col("c2")
    green1, green2 = c1.isin(*VEGETATION), c2.isin(*VEGETATION)
    area = lambda cond: km2(F.sum(F.when(cond, F.col("pixels")).otherwise(0)), pixel_m)
    return transition_counts(pairs).agg(
        area(green1 & (c2 == 1)).alias("vegetation_to_built_km2"), area((c1 == 4) & (c2 == 1)).alias("soil_to_built_km2"),
        area(green1 & ~green2).alias("vegetation_loss_km2"), area((c1 != 1) & (c2 == 1)).alias("urban_gain_km2"),
    )


def footprint(pairs: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    """All, jointly valid and excluded pixels of the frame; nodata pixels count as footprint."""
    out = pairs.agg(F.count("*").alias("footprint_px"), F.count_if(both_valid()).alias("valid_px"))
    out = out.withColumn("excluded_px", F.col("footprint_px") - F.col("valid_px"))
    return out.withColumns({"footprint_km2": km2(F.col("footprint_px"), pixel_m), "valid_km2": km2(F.col("valid_px"), pixel_m), "excluded_km2": km2(F.col("excluded_px"), pixel_m), "excluded_pct": F.round(F.coalesce(F.try_divide(F.col("excluded_px") * 100.0, F.col("footprint_px")), F.lit(0.0)), 2)})


def change_masks(pairs: DataFrame) -> DataFrame:
    """urban, veg_loss, water_change and unchanged flags (1 or 0) of each pixel; null where either class is missing."""
    c1, c2, ok = F.col("c1"), F.col("c2"), both_valid()
    flag = lambda cond: F.when(ok, cond.cast("int"))
    return pairs.select(
        "row", "col", flag((c1 != 1) & (c2 == 1)).alias("urban"), flag(c1.isin(*VEGETATION) & ~c2.isin(*VEGETATION)).alias("veg_loss"),
        flag((c1 == 5) != (c2 == 5)).alias("water_change"), flag(c1 == c2).alias("unchanged"),
    )


def ndvi_decline(first: DataFrame, second: DataFrame, threshold: float = -0.15) -> DataFrame:
    """Difference of two NDVI rasters where both are known, and whether it is below the threshold."""
    both = first.select("row", "col", F.col("ndvi").alias("n1")).join(second.select("row", "col", F.col("ndvi").alias("n2")), ["row", "col"])
    both = both.withColumn("delta", (F.col("n2") - F.col("n1")).cast("float"))
    return both.select("row", "col", "delta", (F.col("delta") < F.lit(threshold).cast("float")).cast("int").alias("declined"))


def encode_mask(mask: Column, nodata: int = 255) -> Column:
    """The file form of a mask: nodata for null."""
    return F.coalesce(mask.cast("int"), F.lit(nodata))


def overlap_stats(df: DataFrame, mapped: Column, other: Column, valid: Column) -> DataFrame:
    """Common and single positives, intersection over union and both overlap shares; null over an empty base."""
    m, o = F.coalesce(mapped, F.lit(False)), F.coalesce(other, F.lit(False))
    out = df.filter(valid).agg(F.count("*").alias("valid_px"), F.count_if(m).alias("mapped_px"), F.count_if(o).alias("external_px"), F.count_if(m & o).alias("common_px"))
    c = F.col
    return out.withColumns({"iou": F.try_divide(c("common_px").cast("double"), c("mapped_px") + c("external_px") - c("common_px")), "mapped_share": F.try_divide(c("common_px").cast("double"), c("mapped_px")), "external_share": F.try_divide(c("common_px").cast("double"), c("external_px"))})


def forest_loss(lossyear: Column, treecover: Column, datamask: Column, first: int, last: int, least_cover: int = 30) -> Column:
    return lossyear.between(first, last) & (treecover >= least_cover) & datamask


def built_gain(before: Column, after: Column) -> Column:
    return (before == 0) & (after > 0)


def mean_difference(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Means of two rasters and of their difference over pixels that both know."""
    both = first.select("row", "col", F.col(value).alias("a")).join(second.select("row", "col", F.col(value).alias("b")), ["row", "col"]).filter("a is not null and b is not null")
    d = lambda c: F.col(c).cast("double")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(d("a")), 9).alias("mean_a"), F.round(F.avg(d("b")), 9).alias("mean_b"), F.round(F.avg(d("b") - d("a")), 9).alias("mean_diff"))
