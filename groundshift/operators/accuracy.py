"""Map accuracy from reference labels: confusion, kappa, class scores, area-adjusted estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = (1, 2, 3, 4, 5)


def frame(spark: SparkSession, a: str, b: str) -> DataFrame:
    return spark.range(25).select(F.floor(F.col("id") / 5 + 1).cast("int").alias(a), (F.col("id") % 5 + 1).cast("int").alias(b))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n for all pairs of the five classes; other values don't count."""
    counts = df.filter(F.col(truth).isin(*LABELS) & F.col(predicted).isin(*LABELS)).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return frame(df.sparkSession, "truth", "predicted").join(F.broadcast(counts), ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class, 0 where undefined."""
    t = matrix.groupBy(F.col("truth").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col("predicted").alias("class_id")).agg(F.sum("n").alias("claimed"))
    out = t.join(p, "class_id").withColumns({"precision": _zero(F.col("hit"), F.col("claimed")), "recall": _zero(F.col("hit"), F.col("support"))})
    f1 = _zero(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return out.select("class_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    w = lambda c: F.round(_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")), 6).alias(f"weighted_{c}")
    m = lambda c: F.round(F.avg(c), 6).alias(f"macro_{c}")
    return report.agg(*[f(c) for c in ("precision", "recall", "f1") for f in (m, w)])


def kappa(matrix: DataFrame) -> DataFrame:
    """n, overall accuracy and Cohen's kappa (null where chance agreement is complete)."""
    t = matrix.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("a"))
    p = matrix.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("b"))
    chance = t.join(p, "k").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("chance"))
    s = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("agree"))
    both = s.join(F.broadcast(chance)).withColumns({"po": F.try_divide(F.col("agree").cast("double"), F.col("n")), "pe": F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))})
    return both.select("n", F.round("po", 9).alias("overall_accuracy"), F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 9).alias("kappa"))


def wilson_interval(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits.cast("double"), n)
    base = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / base, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return centre - half, centre + half


def interrater(labels: DataFrame, item: str, labeller: str, cls: str, first: str, second: str) -> DataFrame:
    """Agreement of two labellers on the items that both labelled."""
    side = lambda who, name: labels.filter((F.col(labeller) == who) & F.col(cls).isNotNull()).select(item, F.col(cls).alias(name))
    return kappa(confusion(side(first, "a").join(side(second, "b"), item), "a", "b")).withColumnRenamed("n", "paired")


def label_warnings(df: DataFrame, cls: str, least: int = 30) -> DataFrame:
    """Messages for too few labels in all or in a class that occurs."""
    per = df.filter(F.col(cls).isin(*LABELS)).groupBy(F.col(cls).alias("class_id")).agg(F.count("*").alias("n"))
    each = per.filter(F.col("n") < least).select(F.format_string(f"Class %d has %d labels, fewer than {least}", "class_id", "n").alias("warning"))
    return each.unionByName(per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")).filter(F.col("n") < least).select(F.format_string(f"Only %d labels, fewer than {least}", "n").alias("warning")))


def area_adjusted(areas: DataFrame, counts: DataFrame, z: float = 1.96) -> DataFrame:
    """Stratified estimate of each class's area: areas (stratum, area), counts (stratum, class_id, n).

    Share of a class: sum of w_h * p_h; variance: sum of w_h^2 p (1 - p) / (n_h - 1) for n_h > 1. Intervals stay in
    [0, total]. Every stratum needs samples: one without any is an error.
    """
    total = areas.agg(F.sum("area").alias("total"))
    per = counts.groupBy("stratum").agg(F.sum("n").alias("n_h"))
    joined = areas.join(per, "stratum", "left").join(counts, "stratum", "left").join(F.broadcast(total))
    w, p = F.col("area") / F.col("total"), F.try_divide(F.col("n").cast("double"), F.when(F.col("n_h") > 0, F.col("n_h")).otherwise(F.raise_error(F.lit("a stratum has no samples"))))
    var = F.when(F.col("n_h") > 1, w * w * p * (1 - p) / (F.col("n_h") - 1)).otherwise(0.0)
    out = joined.groupBy("class_id").agg(F.max("total").alias("total"), F.sum(w * p).alias("share"), F.sum(var).alias("var"))
    area, half = F.col("share") * F.col("total"), F.sqrt("var") * F.col("total") * z
    return out.select("class_id", F.round(area, 6).alias("area"), F.round(F.greatest(F.lit(0.0), area - half), 6).alias("low"), F.round(F.least(F.col("total"), area + half), 6).alias("high"))
