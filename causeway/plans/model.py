"""Gradient-boosted trees over features: fit, score, importance, save and load.

Two kinds: ``gbt``, the trees of Spark's own library, and ``second_order`` (``boosting``), with regularised gains, child
weight and sampled columns.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.scalars import sigmoid
from causeway.plans import boosting
from causeway.plans.boosting import Booster
from causeway.sources.sinks import exists


def fit(
    train: DataFrame, features: list[str], trees: int = 500, depth: int = 8, rate: float = 0.05, subsample: float = 0.8, seed: int = 42, kind: str = "gbt",
    min_child_weight: float = 8.0, columns_by_tree: float = 0.85, reg_lambda: float = 1.0,
) -> PipelineModel | Booster:
    """Boosted trees on ``y`` with ``weight``; nulls and NaN take their own side of splits: below all values (``gbt``, by a
    filler) or above them. The last three settings are those of ``second_order``."""
    if kind == "second_order":
        return boosting.fit(train, features, boosting.Settings(trees, depth, rate, subsample=subsample, columns_by_tree=columns_by_tree, reg_lambda=reg_lambda, min_child_weight=min_child_weight, seed=seed))
    if kind != "gbt":
        raise ValueError(f"unknown kind {kind}")
    gbt = GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, featureSubsetStrategy="all")
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rows = assembler.transform(filled(train, features)).select("features", "y", "weight").persist()  # a fit reads its rows several times
    try:
        return PipelineModel([assembler, gbt.fit(rows)])
    finally:
        rows.unpersist()


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for f in features})


def score(model: PipelineModel | Booster, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``margin``, ``probability_red`` and the sigmoid of the margin."""
    keep = df.columns
    if isinstance(model, Booster):
        out = model.margins(df)
        return out.select(*keep, "margin", sigmoid(F.col("margin")).alias("probability_red"), sigmoid(F.col("margin")).alias("sigmoid"))
    out = model.transform(filled(df, features)).withColumns({"margin": vector_to_array("rawPrediction")[1], "probability_red": vector_to_array("probability")[1]})
    return out.select(*keep, "margin", "probability_red", sigmoid(F.col("margin")).alias("sigmoid"))


def save(model: PipelineModel | Booster, path: str) -> None:
    """The fitted model in a folder that all executors reach; an earlier one there is replaced."""
    if isinstance(model, Booster):
        SparkSession.active().createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> tuple[PipelineModel | Booster, list[str]]:
    """A saved model and the features that it takes, in order."""
    spark = SparkSession.active()
    if exists(spark, f"{path}/metadata"):
        model = PipelineModel.load(path)
        return model, model.stages[0].getInputCols()
    model = boosting.from_json(spark.read.text(path).first()[0])
    return model, model.features


def importance(model: PipelineModel | Booster, features: list[str]) -> list[tuple[str, float]]:
    if isinstance(model, Booster):
        return model.importance()
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: -x[1])
