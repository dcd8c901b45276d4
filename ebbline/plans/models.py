"""Classifiers, and tables scored by them."""

import json
from collections.abc import Mapping

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import flag
from ebbline.operators.metrics import compare_models
from ebbline.operators.splits import class_counts, class_weights
from ebbline.plans.features_stage import AccountFeatures
from ebbline.sources.staging import shared_folder, stage

# The published parameters. Leaf penalties have no counterpart in Spark's trees.
GBT_PRESETS = {
    "a": {
        "maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
    },
    "b": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05},
}
WEIGHT_MODES = {"a": "ratio", "b": "balanced"}
SEED = 42


def training_frame(
    df: DataFrame, features: AccountFeatures, weight_mode: str = "balanced", keep=()
) -> tuple[DataFrame, list]:
    """Assembled training rows (features, label, weight) and the stages that made them."""
    fitted = features.fit(df)
    assembler = VectorAssembler(inputCols=features.getInputCols(), outputCol="features")
    rows = assembler.transform(fitted.transform(df))
    label = flag(F.col(schema.LABEL) == "Yes").alias("label")
    # Written once, in as many files as their size asks for: a fit reads its rows many times.
    rows = stage(rows.select("features", label, *keep).hint("rebalance"), "training")
    # Boosting cuts its lineage there, which every task carries; without it, it grows by each tree.
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return class_weights(rows, "label", weight_mode), [fitted, assembler]


def _fit(df: DataFrame, classifier, features: AccountFeatures, weight_mode: str) -> PipelineModel:
    rows, stages = training_frame(df, features, weight_mode)
    return PipelineModel([*stages, classifier.fit(rows)])


def _columns(classifier):
    return classifier.setFeaturesCol("features").setLabelCol("label").setWeightCol("weight")


def fit_logistic(df: DataFrame, max_iter: int = 1000, c: float = 1.0, chain="notebook"):
    """Balanced logistic regression on scaled features (M1).

    Spark divides the loss by the sum of weights, which balanced weights make the row count,
    so an L2 penalty of strength 1/c becomes 1/(c n).
    """
    features = AccountFeatures(chain=chain, scaled=True)
    rows, stages = training_frame(df, features, "balanced")
    counts = class_counts(rows, "label").first()
    n = max(counts["negatives"] + counts["positives"], 1)
    classifier = _columns(
        LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * n), standardization=False)
    )
    return PipelineModel([*stages, classifier.fit(rows)])


def fit_forest(df: DataFrame, trees: int = 100, depth: int = 6, chain="notebook"):
    """Balanced random forest (M2); Spark refuses a depth above 30."""
    classifier = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
    return _fit(df, _columns(classifier), AccountFeatures(chain=chain), "balanced")


def gbt(preset: str = "a", kind: type[GBTClassifier] = GBTClassifier, **changes) -> GBTClassifier:
    return _columns(kind(**{**GBT_PRESETS[preset], "seed": SEED, **changes}))


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """What boosting would have ended with after ``n`` rounds: its first ``n`` trees."""
    java = model._java_obj
    kind = SparkContext._active_spark_context._jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = GBTClassificationModel(kind(f"{model.uid}_{n}", java.trees()[:n], java.treeWeights()[:n]))
    return cut.setFeaturesCol(model.getFeaturesCol())


def fit_gbt(df: DataFrame, preset: str = "a", chain="notebook", **changes) -> PipelineModel:
    """Boosted trees with one of the two parameter sets (M3, M4); ``kind`` is the estimator's class."""
    features = AccountFeatures(chain=chain)
    return _fit(df, gbt(preset, **changes), features, WEIGHT_MODES[preset])


def prepare_profiles(df: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """Raw profiles to the model's input, with the stored encoders and scaling."""
    for stage in pipeline.stages[:-1]:
        df = stage.transform(df)
    return df


def score(df: DataFrame, model: PipelineModel, name: str, keep: list[str] | None = None):
    """Scored table of one model; rows without a label column get a null label."""
    label = flag(F.col(schema.LABEL) == "Yes") if schema.LABEL in df.columns else F.lit(None)
    given = df.withColumn("_label", label.cast("int"))
    scored = model.transform(given)
    return scored.select(
        F.col(schema.ID).alias("id"),
        F.lit(name).alias("model"),
        F.col("_label").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
        *(keep or []),
    )


def _preparation(model: PipelineModel) -> str:
    """What a model's preparation does, as a text: equal texts make equal vectors."""
    steps = []
    for step in model.stages[:-1]:
        values = {p.name: step.getOrDefault(p) for p in step.params if step.isDefined(p) and p.name != "outputCol"}
        steps.append([type(step).__name__, values])
    return json.dumps(steps, sort_keys=True, default=str)


def score_all(models: Mapping[str, PipelineModel], df: DataFrame, keep=None) -> DataFrame:
    """Every row scored by every model, one long table (M6).

    The rows are read once: each is prepared once for all models that prepare it alike, every
    model adds its score beside the others', and one row per model is made of them at the end.
    ``keep`` names columns of ``df``.
    """
    rows, vectors, results = df.select(F.struct(*df.columns).alias("_row")), {}, []
    for model in models.values():
        steps = _preparation(model)
        if steps not in vectors:
            carried = F.struct("_row", *vectors.values()).alias("_carried")
            ready = prepare_profiles(rows.select("_row.*", carried), model)
            column = f"_vector{len(vectors)}"
            rows = ready.select("_carried.*", F.col(model.stages[-2].getOutputCol()).alias(column))
            vectors[steps] = column
    for i, (name, model) in enumerate(models.items()):
        classifier = model.stages[-1].copy()
        classifier.setFeaturesCol(vectors[_preparation(model)])
        classifier.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_probability{i}").setPredictionCol(f"_prediction{i}")
        rows = classifier.transform(rows)
        results.append(
            F.struct(
                F.lit(name).alias("model"),
                vector_to_array(f"_probability{i}")[1].alias("score"),
                F.col(f"_prediction{i}").cast("int").alias("prediction"),
            )
        )
    label = flag(F.col(f"_row.{schema.LABEL}") == "Yes") if schema.LABEL in df.columns else F.lit(None)
    kept = [F.col(f"_row.{c}").alias(c) for c in keep or []]
    scored = rows.select(
        F.col(f"_row.{schema.ID}").alias("id"), label.cast("int").alias("label"), *kept, F.inline(F.array(*results))
    )
    return scored.select("id", "model", "label", "score", "prediction", *(keep or []))


def soft_vote(scored: DataFrame, name: str = "ensemble") -> DataFrame:
    """Mean score over models, as one more model (M5)."""
    voted = scored.groupBy("id").agg(F.max("label").alias("label"), F.avg("score").alias("score"))
    return voted.select(
        "id",
        F.lit(name).alias("model"),
        "label",
        "score",
        (F.col("score") > 0.5).cast("int").alias("prediction"),
    )


def fit_and_evaluate(fits: Mapping[str, object], train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit every model and compare them on the test rows, in percent (M7)."""
    models = {name: fit(train) for name, fit in fits.items()}
    return compare_models(score_all(models, test), percent=True)
