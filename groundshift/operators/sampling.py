"""Seeded stratified samples, folds and spatial holdouts.

Order comes from a linear congruential key of row, column and seed, so any engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int) -> Column:
    return (F.col("row") * 7919 + F.col("col") * 104729 + F.lit(seed) * 15485863) % 1000003


def stratified_sample(classes: DataFrame, per_class: int, seed: int, class_ids: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Up to per_class pixels of each class without replacement. Sampling is the feature: the limit is its parameter."""
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(draw_key(seed), "row", "col"))
    return classes.filter(F.col("class_id").isin(*class_ids)).withColumn("place", place).filter(F.col("place") <= per_class).drop("place")


def candidate_records(pairs: DataFrame, per_class: int, seed: int) -> DataFrame:
    """Candidates of both epochs (the second with the next seed), each with both predictions, numbered for labelling."""
    parts = []
    for k, c in enumerate(("c1", "c2")):
        drawn = stratified_sample(pairs.withColumn("class_id", F.col(c)), per_class, seed + k)
        parts.append(drawn.select(F.lit(f"t{k + 1}").alias("candidate_epoch"), "row", "col", F.col("class_id").alias("stratum"), F.col("c1").alias("pred_t1"), F.col("c2").alias("pred_t2")))
    both = parts[0].unionByName(parts[1])
    number = F.row_number().over(Window.orderBy("candidate_epoch", "stratum", "row", "col"))
    return both.withColumn("id", F.format_string("candidate-%07d", number))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("candidate_epoch", "stratum").agg(F.count("*").alias("n"))


def kfold(classes: DataFrame, folds: int, seed: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(draw_key(seed), "row", "col"))
    return classes.withColumn("fold", (place - 1) % folds)


def block_key(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws(":", F.floor(x / size).cast("long"), F.floor(y / size).cast("long"))


def block_holdout(labels: DataFrame, size: float, fraction: float, seed: int) -> DataFrame:
    """Whole blocks go to the test side: ceil(fraction * blocks) of them, in the order of a key of their place."""
    bx, by = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
    marked = labels.withColumns({"bx": bx, "by": by, "block": block_key(F.col("x"), F.col("y"), size)})
    blocks = marked.select("bx", "by", "block").distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.orderBy((F.col("bx") * 7919 + F.col("by") * 104729 + seed * 15485863) % 1000003, "bx", "by"))
    chosen = blocks.select("block", (order <= F.ceil(n * fraction)).alias("is_test"))
    return marked.join(chosen, "block").drop("bx", "by")


def class_weights(classes: DataFrame) -> DataFrame:
    """n / (k * n_c) for each class."""
    counts = classes.groupBy("class_id").agg(F.count("*").alias("n_c"))
    everything = Window.partitionBy(F.lit(1))
    return counts.select("class_id", "n_c", F.round(F.sum("n_c").over(everything) / (F.count("*").over(everything) * F.col("n_c")), 9).alias("weight"))
