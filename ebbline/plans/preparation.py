"""The whole preparation, from the raw table to written training data."""

from pyspark.sql import DataFrame, SparkSession

from ebbline import schema
from ebbline.operators.cleaning import clean
from ebbline.operators.encoding import fit_encoders
from ebbline.operators.features import features_library
from ebbline.operators.scaling import apply_scaler, fit_scaler
from ebbline.operators.splits import stratified_split
from ebbline.sources.accounts import read_accounts
from ebbline.sources.prepared import read_prepared, write_prepared
from ebbline.sources.staging import stage


def prepare_accounts(accounts: DataFrame, out: str, test_size: float = 0.2, seed: int = 42):
    """Clean, encode, add features, split, scale on the training part, write.

    Next to the rows are kept the code table and the scaling statistics. Returns the written
    rows, read back.
    """
    spark = accounts.sparkSession
    # Cleaned rows serve the codes and the features, split ones the scaler and the result.
    cleaned = stage(clean(accounts), "cleaned")
    fit_encoders(cleaned).write.mode("overwrite").parquet(f"{out}/codes")
    codes = spark.read.parquet(f"{out}/codes")
    split = stage(stratified_split(features_library(cleaned, codes), test_size=test_size, seed=seed), "split")
    train = split.where("split = 'train'")
    fit_scaler(train, schema.LIBRARY_FEATURES).write.mode("overwrite").parquet(f"{out}/scaler")
    scaled = apply_scaler(split, spark.read.parquet(f"{out}/scaler"))
    write_prepared(scaled, f"{out}/rows")
    return read_prepared(spark, f"{out}/rows")


def prepare(
    spark: SparkSession, path: str, out: str, fmt: str = "csv", test_size: float = 0.2, seed=42
) -> DataFrame:
    """The same from a file."""
    return prepare_accounts(read_accounts(spark, path, fmt), out, test_size, seed)
