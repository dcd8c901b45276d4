"""Feature columns and the two feature chains."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import count_where, flag, ratio, tenure_bucket
from ebbline.operators.encoding import (
    apply_encoders,
    encode_binary,
    encode_label,
    encode_label_strict,
    fit_encoders,
)


def add_charges_per_month(df, total="TotalCharges", tenure="tenure", out="ChargesPerMonth"):
    """Total charges over months plus one (F8)."""
    return df.withColumn(out, ratio(F.col(total), F.col(tenure) + 1))


def add_charges_per_tenure(df, monthly="MonthlyCharges", tenure="tenure", out="charges_per_tenure"):
    """Monthly charge over months plus one."""
    return df.withColumn(out, ratio(F.col(monthly), F.col(tenure) + 1))


def add_tenure_group(
    df: DataFrame,
    labels: list | None = None,
    include_lowest: bool = True,
    open_ended: bool = False,
    tenure: str = "tenure",
    out: str = "TenureGroup",
) -> DataFrame:
    """Right-closed tenure buckets (F10); without 0 (F11); open at both ends."""
    return df.withColumn(out, tenure_bucket(F.col(tenure), labels, include_lowest, open_ended))


def add_total_services(df, columns=None, out="TotalServices"):
    """How many *encoded* service codes are above zero.

    Codes are alphabetical, so "No internet service" (1) counts as a service, as it does in
    the feature this reproduces; ``add_num_services`` counts subscriptions only.
    """
    return df.withColumn(out, count_where(columns or schema.SERVICE_COLUMNS, lambda c: c > 0))


def add_num_services(df, columns=None, out="num_services"):
    """How many services are taken, before encoding."""
    return df.withColumn(out, count_where(columns or schema.SERVICE_COLUMNS, lambda c: c == "Yes"))


def add_senior_alone(df, out="senior_alone"):
    """Senior without a partner."""
    return df.withColumn(out, flag((F.col("SeniorCitizen") == 1) & (F.col("Partner") == "No")))


def add_monthly_contract(df, out="is_monthly_contract"):
    """Contract by the month (F16)."""
    return df.withColumn(out, flag(F.col("Contract") == "Month-to-month"))


def add_fiber_no_security(df, out="fiber_no_security"):
    """Fiber line without online security."""
    fiber, open_line = F.col("InternetService") == "Fiber optic", F.col("OnlineSecurity") == "No"
    return df.withColumn(out, flag(fiber & open_line))


def default_total_charges(df: DataFrame, floor: int = 0) -> DataFrame:
    """Absent total charges as monthly charge x months, at least ``floor`` months."""
    guess = F.col("MonthlyCharges") * F.greatest(F.col("tenure"), F.lit(floor))
    if "TotalCharges" not in df.columns:
        return df.withColumn("TotalCharges", guess)
    return df.withColumn("TotalCharges", F.coalesce("TotalCharges", guess))


def with_feature_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Absent features as constant 0."""
    absent = {c: F.lit(0) for c in names if c not in df.columns}
    return df.withColumns(absent) if absent else df


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Feature vector in the given order; an absent feature is 0."""
    return VectorAssembler(inputCols=names, outputCol=out).transform(with_feature_columns(df, names))


def add_library_features(df: DataFrame) -> DataFrame:
    """The three features computed on encoded columns."""
    return df.transform(add_charges_per_month).transform(add_tenure_group).transform(add_total_services)


def add_notebook_features(df: DataFrame) -> DataFrame:
    """The five features computed on raw texts."""
    return (
        df.transform(add_num_services)
        .transform(add_charges_per_tenure)
        .transform(add_senior_alone)
        .transform(add_monthly_contract)
        .transform(add_fiber_no_security)
    )


def features_library(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Cleaned table to label, encoded columns and three features."""
    codes = fit_encoders(df) if codes is None else codes
    encoded = df.transform(encode_label).transform(encode_binary)
    return encoded.transform(apply_encoders, codes).transform(add_library_features)


def features_notebook(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Cleaned table to label, five features, then encoded columns."""
    codes = fit_encoders(df) if codes is None else codes
    flagged = df.transform(encode_label_strict).transform(add_notebook_features)
    binary = flagged.transform(encode_binary, schema.BINARY_COLUMNS, strict=True)
    return binary.transform(apply_encoders, codes)
