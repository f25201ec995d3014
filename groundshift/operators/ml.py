"""Random-forest land cover with pyspark.ml: features, pseudo-labels, training, prediction, validation."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.operators import accuracy, raster, sampling
from groundshift.sources import fixtures as fx

#: Order of the features; terrain is 0 where no elevation model is given.
FEATURES = (*raster.BANDS, *raster.INDICES, "slope", "aspect_sin", "aspect_cos")


def features(indexed: DataFrame, terrain: DataFrame | None = None) -> DataFrame:
    if terrain is None:
        return indexed.withColumns({c: F.lit(0.0) for c in ("slope", "aspect_sin", "aspect_cos")})
    return indexed.join(terrain.select("row", "col", "slope", "aspect_sin", "aspect_cos"), ["row", "col"], "left")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(raster.classify(raster.indices(fx.composite(spark, sf_dir))).filter("epoch = 't2'").drop("epoch"))


def training_sample(rows: DataFrame, per_class: int, seed: int) -> DataFrame:
    """Rule-labelled rows, up to per_class of each class, without rows that miss a feature."""
    return sampling.stratified_sample(rows.dropna(subset=list(FEATURES)), per_class, seed)


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip").transform(rows)


def fit(sample: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    weighted = sample.join(F.broadcast(sampling.class_weights(sample).select("class_id", "weight")), "class_id").withColumn("label", F.col("class_id").cast("double"))
    # Vectors come before the sort that fixes the row order of the bootstrap.
    ordered = _vectors(weighted).select("features", "label", "weight", "row", "col").repartition(1).sortWithinPartitions("row", "col")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed).fit(ordered)


def predict(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """row, col, class_id; 0 where a feature is missing."""
    found = model.transform(_vectors(rows)).select("row", "col", F.col("prediction").cast("int").alias("predicted"))
    return rows.select("row", "col").join(found, ["row", "col"], "left").select("row", "col", F.coalesce("predicted", F.lit(0)).alias("class_id"))


def train_and_predict(rows: DataFrame, per_class: int = 500, trees: int = 100, seed: int = 42) -> DataFrame:
    return predict(fit(training_sample(rows, per_class, seed), trees, seed=seed), rows)


def importances(rows: DataFrame, per_class: int = 500, trees: int = 100, seed: int = 42) -> DataFrame:
    model = fit(training_sample(rows, per_class, seed), trees, seed=seed)
    return rows.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def cross_validate(rows: DataFrame, per_class: int = 500, trees: int = 100, folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean and population deviation of accuracy and kappa over stratified folds; out-of-bag scores don't exist here."""
    sample = sampling.kfold(training_sample(rows, per_class, seed), folds, seed).cache()
    scores = []
    for k in range(folds):
        test = sample.filter(F.col("fold") == k)
        predicted = predict(fit(sample.filter(F.col("fold") != k), trees, seed=seed), test).withColumnRenamed("class_id", "predicted")
        scores.append(accuracy.kappa(accuracy.confusion(test.join(predicted, ["row", "col"]), "class_id", "predicted")).first())
    sample.unpersist()
    rows_out = [(k, s.overall_accuracy, s.kappa) for k, s in enumerate(scores)]
    return rows.sparkSession.createDataFrame(rows_out, "fold int, accuracy double, kappa double").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy"), F.avg("kappa").alias("mean_kappa"), F.stddev_pop("kappa").alias("sd_kappa"))
