"""Feature importances of fitted models."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def feature_importance(
    spark: SparkSession, model, names: list[str], n: int = 15, name: str = "model"
) -> DataFrame:
    """The ``n`` most important features of a fitted tree model.

    One number per feature crosses the driver. A model without importances is refused.
    """
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if not hasattr(stage, "featureImportances"):
        raise ValueError(f"{type(stage).__name__} has no feature importances")
    weights = stage.featureImportances.toArray()
    rows = [(name, f, float(w)) for f, w in zip(names, weights, strict=True)]
    table = spark.createDataFrame(rows, "model string, feature string, importance double")
    return top_features(table, n)


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    """Top features per model, also relative to the strongest one."""
    whole = Window.partitionBy("model")
    ranked = whole.orderBy(F.desc("importance"), "feature")
    relative = F.try_divide(F.col("importance"), F.max("importance").over(whole))
    out = importances.withColumns(
        {"place": F.row_number().over(ranked), "relative": relative}
    )
    return out.where(F.col("place") <= n)


def combined_importance(importances: DataFrame, n: int = 10) -> DataFrame:
    """Importances of each model brought to sum 1, averaged over models, top ``n``."""
    total = F.sum("importance").over(Window.partitionBy("model"))
    shares = importances.withColumn("share", F.try_divide(F.col("importance"), total))
    return (
        shares.groupBy("feature")
        .agg(F.avg("share").alias("mean_share"))
        .orderBy(F.desc("mean_share"), "feature")
        .limit(n)
    )


def importance_shares(importances: DataFrame, n: int = 10) -> DataFrame:
    """Each model's own share of the ``n`` features with the highest mean share."""
    total = F.sum("importance").over(Window.partitionBy("model"))
    shares = importances.select("feature", "model", F.try_divide(F.col("importance"), total).alias("share"))
    # At most n rows.
    return shares.join(F.broadcast(combined_importance(importances, n)), "feature")
