"""Cleaning steps: each takes a table and returns a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.operators.ordered import approximate_quantiles, exact_quantiles
from ebbline.sources.staging import stage


def drop_identifier(df: DataFrame, identifier: str = schema.ID) -> DataFrame:
    """Drop the key if the table has it."""
    return df.drop(identifier)


def coerce_numeric(df: DataFrame, column: str = "TotalCharges") -> DataFrame:
    """Text to number; text that is no number becomes null."""
    return df.withColumn(column, F.col(column).try_cast("double"))


def median_of(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """One row with the median; ``approx`` reads one sketch instead of shuffling values."""
    if approx:
        return approximate_quantiles(df, [], column, [0.5]).select(F.col("q0").alias("median"))
    # Read once: what the exact median reads again is the one column.
    values = stage(df.select(column).dropna(), "values")
    return exact_quantiles(values, [], column, [0.5]).select(F.col("q0").alias("median"))


def impute_median(df: DataFrame, column: str = "TotalCharges", approx: bool = False) -> DataFrame:
    """Fill nulls with the column's median, exact by default."""
    middle = median_of(df, column, approx).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), middle))


def impute_constant(df: DataFrame, column: str = "TotalCharges", value: float = 0.0) -> DataFrame:
    """Fill nulls with a constant: tenure 0 means no charges yet."""
    return df.fillna({column: value})


def clean(df: DataFrame, keep_id: bool = True, approx: bool = False) -> DataFrame:
    """Numeric charges with the median for blanks (C12); the key stays for tracing rows."""
    out = df.transform(coerce_numeric).transform(impute_median, approx=approx)
    return out if keep_id else drop_identifier(out)
