"""First look at a table: shape, description, missing values, label shares."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline import schema
from ebbline.operators.ordered import approximate_quantiles, exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def is_text(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, T.StringType)


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _one_row_to_many(df: DataFrame, structs: list) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def table_profile(df: DataFrame) -> DataFrame:
    """Position, name, type and missing count of every column, with the table's shape."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_missing{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.col("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.col(f"_missing{i}").alias("n_missing"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return _one_row_to_many(counted, rows)


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order`` if the table has no order of its own."""
    return (df.orderBy(*order) if order else df).limit(n)


def _long(df: DataFrame, columns: list[str], as_type: str, name: str, value: str) -> DataFrame:
    casted = df.select(*[F.col(c).cast(as_type).alias(c) for c in columns])
    return casted.unpivot([], columns, name, value).where(F.col(value).isNotNull())


def describe_numbers(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    values = _long(df, columns, "double", "column_name", "value").where(~F.isnan("value"))
    moments = values.groupBy("column_name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    quantiles = approximate_quantiles if approx else exact_quantiles
    quartiles = quantiles(values, ["column_name"], "value", QUARTILES)
    # One row per column of the table on either side.
    return quartiles.join(F.broadcast(moments), "column_name").select(
        "column_name",
        F.col("n").alias("n_values"),
        F.lit(None).cast("bigint").alias("n_distinct"),
        F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("bigint").alias("top_count"),
        "mean",
        "std",
        "min",
        F.col("q0").alias("p25"),
        F.col("q1").alias("p50"),
        F.col("q2").alias("p75"),
        "max",
    )


def describe_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    values = _long(df, columns, "string", "column_name", "value")
    counts = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("double")
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("top_count"),
    ).select("*", *[nothing.alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def describe_all(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, distinct, top value, mean, sample std and quartiles of every column.

    What is no number (dates, timestamps, booleans) is described by its text. NaN counts as missing.
    """
    columns = columns or df.columns
    numbers = [c for c in columns if is_number(df, c)]
    texts = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        parts.append(describe_numbers(df, numbers, approx))
    if texts:
        parts.append(describe_texts(df, texts))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage (2 places) of the columns that miss any."""
    columns = columns or df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = counted.unpivot(["n"], columns, "column_name", "n_missing")
    percent = F.round(F.col("n_missing") * 100.0 / F.col("n"), 2)
    return long.where("n_missing > 0").select("column_name", "n_missing", percent.alias("pct_missing"))


def label_distribution(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """Count and share of each label (C4)."""
    counts = df.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The total is summed over the counted labels, not over the table.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(F.col(label).alias("label"), "n", (F.col("n") / total).alias("share"))


def missing_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The rows that miss ``column``, projected."""
    return df.where(F.col(column).isNull()).select(*keep)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value of every categorical column, in one pass."""
    return _long(df, columns, "string", "column_name", "value").distinct()


def remaining_text_columns(df: DataFrame) -> DataFrame:
    """Columns that are still textual, with their filled rows: work left for an encoder (C11)."""
    names = [c for c in df.columns if is_text(df, c)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n_values bigint")
    counted = df.agg(*[F.count(c).alias(c) for c in names])
    return counted.unpivot([], names, "column_name", "n_values")
