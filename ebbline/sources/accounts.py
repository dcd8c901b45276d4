"""Reading the customer table, with bad records set apart if asked for."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline import schema


def read_accounts(spark: SparkSession, path: str, fmt: str = "csv", mode: str = "PERMISSIVE"):
    """Customer table from CSV (with header), Parquet, ORC or JSON, never inferred."""
    reader = spark.read.schema(schema.ACCOUNT_SCHEMA)
    if fmt == "csv":
        return reader.option("header", True).option("mode", mode).csv(path)
    return reader.format(fmt).load(path)


# Holds the text of a record that doesn't fit the schema.
BAD_RECORD = "_bad_record"


def read_accounts_checked(
    spark: SparkSession, path: str, fmt: str = "csv", stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Customer table from CSV (with header) or JSON, with ``BAD_RECORD``: the text of a record with
    a missing or extra field or one of the wrong type, null for a sound one. Batch or stream."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"only csv and json keep a bad record's text, not {fmt}")
    fields = T.StructType([*schema.ACCOUNT_SCHEMA, T.StructField(BAD_RECORD, T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(fields).format(fmt)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A record is judged by the fields that are read; this always true condition reads all of
    # them wherever the judgement is asked for.
    all_fields = F.xxhash64(*schema.ACCOUNT_COLUMNS) >= F.lit(-(2**63))
    return reader.load(path).withColumn(BAD_RECORD, F.when(all_fields, F.col(BAD_RECORD)))


def sound_records(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def bad_records(checked: DataFrame) -> DataFrame:
    """The key, as far as it could be read, and the text of each bad record."""
    return checked.where(F.col(BAD_RECORD).isNotNull()).select(schema.ID, F.col(BAD_RECORD).alias("record"))


def write_accounts_csv(df: DataFrame, path: str) -> None:
    """Customer table as CSV with header; blanks in text fields survive a round trip."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
