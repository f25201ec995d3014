"""Pixel observations to masked, normalised, composited and classified rasters.

Bands are float columns, missing values are null throughout; every step is a projection or a group-by on pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
INDICES = ("ndvi", "ndbi", "mndwi", "bsi")
# Scene classes that hide the ground (no data, saturated, dark, shadow, clouds, cirrus, snow).
MASKED_SCL = (0, 1, 2, 3, 8, 9, 10, 11)
# Class codes of the land-cover map; 0 is unclassified.
CLASSES = {1: "built", 2: "tree", 3: "crop", 4: "bare", 5: "water"}


def scl_valid(scl: Column, masked: tuple[int, ...] = MASKED_SCL) -> Column:
    return scl.isNotNull() & ~scl.isin(*masked)


def mask_stack(px: DataFrame, masked: tuple[int, ...] = MASKED_SCL) -> DataFrame:
    """Null all bands of an observation unless its scene class is valid and all bands are there; adds `valid`."""
    valid = scl_valid(F.col("scl"), masked)
    for b in BANDS:
        valid = valid & F.col(b).isNotNull() & ~F.isnan(b)
    return px.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumns({b: F.when(F.col("valid"), F.col(b)).cast("float") for b in BANDS})


def valid_fraction(masked: DataFrame) -> DataFrame:
    """Share of valid observations of each pixel and epoch; invalid ones count below the line."""
    return masked.groupBy("epoch", "row", "col").agg(F.avg(F.col("valid").cast("double")).cast("float").alias("valid_frac"))


def coverage(fractions: DataFrame, least: float = 0.7, warn: float = 0.3) -> DataFrame:
    """Whether the mean valid fraction of an epoch suffices, and whether its worst pixel calls for a warning."""
    out = fractions.groupBy("epoch").agg(F.avg(F.col("valid_frac").cast("double")).alias("mean_frac"), F.min("valid_frac").alias("min_frac"))
    return out.select("epoch", "mean_frac", "min_frac", (F.col("mean_frac") >= least).alias("ok"), (F.col("min_frac") < F.lit(warn)).alias("warned"))


def median_composite(masked: DataFrame) -> DataFrame:
    """Exact median of each band over time; the mean of the middle two for even counts, null if nothing is valid."""
    return masked.groupBy("epoch", "row", "col").agg(*[F.median(b).cast("float").alias(b) for b in BANDS])


def month_balanced_composite(masked: DataFrame) -> DataFrame:
    """Median of calendar-month medians, years pooled, so that a month with many scenes weighs no more than others."""
    monthly = masked.groupBy("epoch", "row", "col", F.month("ts").alias("month")).agg(*[F.median(b).cast("float").alias(b) for b in BANDS])
    return median_composite(monthly)


def _ratio(top: Column, bottom: Column) -> Column:
    # least and greatest skip nulls, so the clip stays inside the guard.
    return F.when(bottom != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (top / bottom).cast("float").cast("double")))).cast("float")


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) in 32-bit floats, clipped to [-1, 1]; null where the sum is zero."""
    return _ratio(a - b, a + b)


def bare_soil_index(b11: Column, b04: Column, b08: Column, b02: Column) -> Column:
    soil, green = b11 + b04, b08 + b02
    return _ratio(soil - green, soil + green)


def index_columns() -> dict[str, Column]:
    c = F.col
    return {"ndvi": normalized_difference(c("b08"), c("b04")), "ndbi": normalized_difference(c("b11"), c("b08")), "mndwi": normalized_difference(c("b03"), c("b11")), "bsi": bare_soil_index(c("b11"), c("b04"), c("b08"), c("b02"))}


def indices(composite: DataFrame) -> DataFrame:
    return composite.withColumns(index_columns())


def ndvi_epsilon(nir: Column, red: Column) -> Column:
    """The unclipped variant that treats sums of at most 1e-8 as missing."""
    return F.when(F.abs((nir + red).cast("double")) > 1e-8, ((nir - red) / (nir + red)).cast("float"))


def rule_class() -> Column:
    """Water, built, tree, crop, bare, in this order; 0 if none applies or an index is missing."""
    f = lambda x: F.lit(x).cast("float")
    missing = F.col("ndvi").isNull() | F.col("ndbi").isNull() | F.col("mndwi").isNull() | F.col("bsi").isNull()
    return (
        F.when(missing, 0).when(F.col("mndwi") > f(0), 5).when((F.col("ndbi") > F.col("ndvi")) & (F.col("ndbi") > f(0)), 1)
        .when(F.col("ndvi") > f(0.5), 2).when(F.col("ndvi") > f(0.25), 3).when(F.col("bsi") > f(0), 4).otherwise(0)
    )


def classify(indexed: DataFrame) -> DataFrame:
    return indexed.withColumn("class_id", rule_class())


def reflectance_offset(offset: Column, baseline: Column, day: Column, flag_present: Column, flag: Column) -> Column:
    """The offset that a scene's numbers still need, from its declared one, processing baseline, date and provider flag."""
    declared = F.coalesce(offset, F.lit(0.0))
    close = lambda v: F.abs(declared - F.lit(v)) <= 1e-8 + 1e-5 * abs(v)
    number = F.coalesce(F.expr("try_cast(baseline as double)") if baseline is None else baseline.try_cast("double"), F.lit(0.0))
    applied = flag_present & F.coalesce(flag, F.lit(False))
    late = (number >= 4.0) & (F.coalesce(day, F.lit("")) >= "2022-01-25")
    return F.when(flag_present & close(-0.1), 0.0).when(~applied & late & close(0.0), -0.1).otherwise(declared)


def normalize_reflectance(px: DataFrame, coefficients: DataFrame) -> DataFrame:
    """number * scale + offset for each band of a scene, in 32-bit floats; the scene class is left alone."""
    joined = px.join(coefficients, "scene_id")
    return joined.withColumns({b: (F.col(b).cast("double") * F.col("scale") + F.col("offset")).cast("float") for b in BANDS}).drop("scale", "offset")


def band_stats(composite: DataFrame, with_median: bool = False, accuracy: int | None = None) -> DataFrame:
    """count, min, mean and max (and median) of each band and epoch.

    The median is exact unless an accuracy is given; an exact one keeps all distinct values of a band in memory, so
    rasters of many distinct values need an accuracy.
    """
    long = composite.select("epoch", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in BANDS])).alias("x")).select("epoch", "x.band", "x.v")
    aggs = [F.count("v").alias("n"), F.min("v").alias("min_v"), F.round(F.avg(F.col("v").cast("double")), 9).alias("mean_v"), F.max("v").alias("max_v")]
    return long.groupBy("epoch", "band").agg(*aggs, *([F.median("v").alias("median_v") if accuracy is None else F.percentile_approx("v", 0.5, accuracy).alias("median_v")] if with_median else []))


def percentile_stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, accuracy: int | None = None) -> DataFrame:
    """value stretched from its percentiles to [0, 1] and clipped; zero everywhere if they coincide.

    Percentiles are exact unless an accuracy is given, as large rasters need.
    """
    shares = F.array(F.lit(low), F.lit(high))
    ends = df.agg((F.percentile(value, shares) if accuracy is None else F.percentile_approx(value, shares, accuracy)).alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value).cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    # One row of percentiles beside every pixel.
    return df.join(F.broadcast(ends)).withColumn("stretched", F.when(F.col("hi") > F.col("lo"), F.when(F.col(value).isNotNull(), scaled)).otherwise(F.when(F.col(value).isNotNull(), 0.0))).drop("lo", "hi")
