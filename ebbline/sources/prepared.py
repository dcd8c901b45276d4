"""Prepared training data, search results and fitted models on disk."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_prepared(df: DataFrame, path: str, split: str = "split") -> None:
    """One dataset, a directory per part."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_prepared(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """All rows, or one part: only its directory is read (S3)."""
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col("split") == part)


def write_search_results(trials: DataFrame, path: str) -> None:
    """Ranked trials as CSV with header, best first over the numbered files."""
    ordered = trials.orderBy("rank", "trial")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def model_path(path: str, model_type: str) -> str:
    return f"{path.rstrip('/')}/{model_type}"


def save_pipeline(model: PipelineModel, path: str, model_type: str) -> None:
    """Encoders, feature list, scaling and classifier as one pipeline."""
    model.write().overwrite().save(model_path(path, model_type))


def load_pipeline(path: str, model_type: str, known: tuple[str, ...] = ()) -> PipelineModel:
    """A saved pipeline by name; an unknown or missing name is an error."""
    if known and model_type not in known:
        raise ValueError(f"model_type is one of {', '.join(known)}, not {model_type!r}")
    try:
        return PipelineModel.load(model_path(path, model_type))
    except Exception as error:
        raise FileNotFoundError(f"no saved model {model_type!r} under {path}") from error
