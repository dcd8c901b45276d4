"""Z-scores with the population standard deviation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a struct (mean, std) per column; a constant column gets std 1."""

    def stats(c: str):
        spread = F.stddev_pop(F.col(c).cast("double"))
        std = F.when(spread == 0, 1.0).otherwise(spread)
        return F.struct(F.avg(c).alias("mean"), std.alias("std")).alias(c)

    return df.agg(*[stats(c) for c in columns])


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale with stored statistics, read once as a scalar subquery."""
    whole = stats.select(F.struct("*").alias("s")).scalar()
    scaled = {
        c: (F.col(c) - F.col("_stats")[c]["mean"]) / F.col("_stats")[c]["std"]
        for c in stats.columns
    }
    return df.withColumn("_stats", whole).withColumns(scaled).drop("_stats")


def scale_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fit on every row and apply."""
    return apply_scaler(df, fit_scaler(df, columns))


def scale_train_test(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Fit on the training rows, apply to all."""
    return apply_scaler(df, fit_scaler(df.where(F.col(split) == "train"), columns))


def scaling_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each scaled column, 4 places; 0 where it was fitted."""
    means = df.agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])
    return means.unpivot([], columns, "feature", "mean")
