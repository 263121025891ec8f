"""Classifiers for a rare class, and one training run over a table set."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import bucket, is_test
from ..operators.cohorts import label
from ..operators.evaluate import confusion, error_lists
from ..operators.vectors import as_vector
from ..session import keep
from ..sources import store

# The weight of a case in the default learner, and the other weights on offer.
CASE_WEIGHT = 400
OTHER_CASE_WEIGHTS = (10, 100, 200)
SEED = 17
# Partitions of the training rows for each core; a learner makes hundreds of passes and every task of each reports to the driver.
PARTITIONS_PER_CORE = 2


def learner(kind: str = "boosted", **settings):
    """An unfitted learner on columns ``features``, ``label`` and ``weight``; ``settings`` override."""
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if kind == "boosted":
        return GBTClassifier(**common, **{"maxDepth": 6, "maxIter": 100, "stepSize": 0.3, "seed": SEED, **settings})
    if kind == "logistic":
        return LogisticRegression(**common, **settings)
    if kind == "forest":
        return RandomForestClassifier(**common, **{"numTrees": 100, "seed": SEED, **settings})
    if kind == "svm":
        return LinearSVC(**common, **settings)
    if kind == "lasso":
        regression = LinearRegression(elasticNetParam=1.0, **common, **settings)
        grid = ParamGridBuilder().addGrid(regression.regParam, [0.001, 0.01, 0.1]).build()
        return CrossValidator(estimator=regression, estimatorParamMaps=grid, numFolds=5, seed=SEED,
                              evaluator=RegressionEvaluator(labelCol="label", weightCol="weight"))
    raise ValueError(f"unknown learner: {kind}")


def labelled(matrix: DataFrame, cases: DataFrame, case_weight: float = CASE_WEIGHT) -> DataFrame:
    """``(pid, features, label, weight, is_test)``, with features as vectors."""
    return (
        label(matrix, cases)
        .withColumn("features", as_vector(F.col("features")))
        .withColumn("weight", F.when(F.col("label") == 1, F.lit(float(case_weight))).otherwise(F.lit(1.0)))
        .withColumn("is_test", is_test(bucket(F.col("pid"))))
    )


def fit(data: DataFrame, kind: str = "boosted", **settings) -> PipelineModel:
    """Fit on the training part; the learner makes many passes, hence the persisted input.

    Its partitions grow in size with the rows, not in number, so that what all passes send to the driver does not grow.
    """
    most = PARTITIONS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism
    rows = keep(data.where(~F.col("is_test")).select("features", "label", "weight").coalesce(most))
    try:
        return without_summary(Pipeline(stages=[learner(kind, **settings)]).fit(rows))
    finally:
        rows.unpersist()


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model without the summaries of its training, which hold the session: a session that has made an observation
    cannot be sent to executors, and so the model could not predict there."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def predict(model: PipelineModel, data: DataFrame) -> DataFrame:
    """``(pid, label, is_test, prediction)`` with 0/1 predictions for train and test patients."""
    return model.transform(data).select(
        "pid", "label", "is_test", (F.col("prediction") >= 0.5).cast("int").alias("prediction")
    )


def coefficients(model: PipelineModel, names: list[str]) -> DataFrame:
    """``(column_name, coefficient)`` of a linear model."""
    values = model.stages[-1].coefficients.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, values)), "column_name string, coefficient double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_and_check(matrix: DataFrame, cases: DataFrame, columns: list[str], run: str, tables: str,
                    kind: str = "boosted", case_weight: float = CASE_WEIGHT,
                    model_path: str | None = None, predictions_path: str | None = None, **settings) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """One learner on one table set: its result row, its error lists, and the model.

    ``predictions_path`` keeps the predictions, so that all that is derived from them reads files.
    """
    if not run:
        raise ValueError("a run needs a name")
    data = labelled(matrix, cases, case_weight)
    model = fit(data, kind, **settings)
    if model_path:
        save_model(model, model_path)
    said = predict(model, data)
    if predictions_path:
        said = store.save(said, predictions_path)
    name = f"{kind}{case_weight:g}"
    result = confusion(said.where("is_test")).select(
        F.lit(run).alias("run"), F.lit(name).alias("model"), F.lit(tables).alias("tables"),
        F.lit(len(columns)).alias("num_columns"), "tp", "fp", "tn", "fn", "sensitivity", "specificity",
    )
    lists = error_lists(said).select(F.lit(run).alias("run"), F.lit(name).alias("model"), F.lit(tables).alias("tables"), "kind", "pid")
    return result, lists, model
