"""Scoring profiles as they arrive."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbline import schema
from ebbline.functions.expressions import risk_level
from ebbline.operators.decisions import decision_columns, recommendations
from ebbline.plans.features_stage import with_raw_columns
from ebbline.plans.models import score
from ebbline.sources.accounts import bad_records, sound_records


def read_profile_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Profiles from a folder that files are dropped into."""
    reader = spark.readStream.schema(schema.ACCOUNT_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def decide(scored: DataFrame) -> DataFrame:
    """Result record and advice of every scored row; projections only, so fit for a stream."""
    advised = recommendations(scored)
    columns = decision_columns(F.col("score"), F.col("prediction"), F.col("model"))
    return advised.select("id", *columns, "advice")


def score_stream(stream: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Stateless scoring with a fitted pipeline (P9); absent columns count as null."""
    keep = ["_raw." + c for c in ADVICE_COLUMNS]
    kept = with_raw_columns(stream).withColumn("_raw", F.struct(*ADVICE_COLUMNS))
    return decide(score(kept, model, name, keep))


# The raw fields the advice rules read; scoring replaces them by codes.
ADVICE_COLUMNS = [
    "Contract", "MonthlyCharges", "tenure", "TechSupport", "OnlineSecurity", "PaymentMethod",
]


def run_stream(
    stream: DataFrame,
    plan: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply a plan to a stream and append to Parquet; progress is kept in ``checkpoint``."""
    writer = (
        plan(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_checked_stream(
    stream: DataFrame,
    plan: Callable[[DataFrame], DataFrame],
    out: str,
    quarantine: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply a plan to the sound records of a checked stream; keep the texts of the others apart.

    ``stream`` comes from ``read_accounts_checked``. Each batch writes its own folder under
    ``out`` and ``quarantine``, and writes it anew if it has to be repeated, so that every record
    ends in one of the two exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(sound_records(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad_records(batch).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
