"""Gradient-boosted trees on the feature tables (distributed MLlib trees) and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.folds import class_weight
from barloom.operators.scaling import apply_scale, fit_robust, train_rows

# Default tree settings.
DIRECTION = {"stepSize": 0.03, "maxDepth": 5, "subsamplingRate": 0.9, "seed": 42}
RESIDUAL = {"stepSize": 0.025, "maxDepth": 7, "subsamplingRate": 0.8, "seed": 42}


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_direction(df: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 50, **params) -> PipelineModel:
    """Direction classifier on train rows with positives weighted by the class balance.

    With validation rows present, boosting stops when they no longer improve.
    """
    w = class_weight(train_rows(df), label, ()).withColumnRenamed("scale_pos_weight", "_pos")
    rows = df.crossJoin(F.broadcast(w))
    rows = rows.withColumns({"_weight": F.when(F.col(label) == 1, F.col("_pos")).otherwise(1.0), "_val": F.col("role") == "val"})
    gbt = GBTClassifier(labelCol=label, featuresCol="features", weightCol="_weight", validationIndicatorCol="_val", maxIter=rounds, **{**DIRECTION, **params})
    return Pipeline(stages=[_assembler(features), gbt]).fit(rows)


def direction_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability of an up move; cast the weights away."""
    out = model.transform(df)
    return out.withColumn("prob", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def walk_forward_direction(df: DataFrame, features: Sequence[str], folds: Sequence[int], label: str = "label", rounds: int = 20, **params) -> DataFrame:
    """Out-of-fold probabilities: per fold a robust scaler and a classifier, fitted on the train rows only.

    The loop runs over the few folds; every fit is a distributed job.
    """
    out = None
    for k in folds:
        part = df.where(F.col("fold") == k)
        scaled = apply_scale(part, fit_robust(train_rows(part), features), features)
        model = train_direction(scaled, features, label, rounds, **params)
        scored = direction_probability(model, scaled.where("role = 'val'"))
        out = scored if out is None else out.unionByName(scored)
    return out


def train_residual(df: DataFrame, features: Sequence[str], target: str = "residual", rounds: int = 50, **params) -> PipelineModel:
    """Regressor of what a first forecast leaves over."""
    rows = df.withColumn("_val", F.col("role") == "val")
    gbt = GBTRegressor(labelCol=target, featuresCol="features", validationIndicatorCol="_val", maxIter=rounds, **{**RESIDUAL, **params})
    return Pipeline(stages=[_assembler(features), gbt]).fit(rows)


def importances(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of the fitted trees."""
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def score(model: PipelineModel, df: DataFrame, base: str | None = None) -> DataFrame:
    """Predictions of a fitted pipeline, added to a base forecast if given."""
    out = model.transform(df).drop("features")
    if base is not None:
        out = out.withColumn("prediction", F.col("prediction") + F.col(base))
    return out
