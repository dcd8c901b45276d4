"""Rates, counts and key figures by segment.

Each question is one aggregation that combines on the map side, so a segment with a third of
all rows costs no more than any other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import TENURE_LABELS, TENURE_LABELS_MONTHS, ratio, tenure_bucket
from ebbline.operators.features import add_num_services


def _churned(label: str = schema.LABEL, positive="Yes") -> Column:
    return F.col(label) == positive


def _rate(condition: Column) -> Column:
    """Share of rows that meet the condition; a null label does not."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def kpis(df: DataFrame, ref_rate: float = schema.REFERENCE_CHURN_RATE) -> DataFrame:
    """Clients, churn rate and its distance to a reference, tenure, revenue at risk."""
    at_risk = F.sum(F.when(_churned(), F.col("MonthlyCharges")))
    return df.agg(
        F.count(F.lit(1)).alias("n_clients"),
        _rate(_churned()).alias("churn_rate"),
        (_rate(_churned()) - ref_rate).alias("rate_delta"),
        F.avg("tenure").alias("mean_tenure"),
        F.avg("MonthlyCharges").alias("mean_monthly"),
        F.coalesce(at_risk, F.lit(0.0)).alias("revenue_at_risk"),
    )


def rate_by_group(
    df: DataFrame, group: str, label: str = schema.LABEL, positive="Yes"
) -> DataFrame:
    """Share of the positive label per group; groups without one are absent."""
    counted = df.dropna(subset=[group]).groupBy(group).agg(
        F.count_if(_churned(label, positive)).alias("n_positive"), F.count(F.lit(1)).alias("total")
    )
    return counted.where("n_positive > 0").select(
        F.col(group).alias("segment"),
        "n_positive",
        "total",
        ratio(F.col("n_positive"), F.col("total")).alias("rate"),
    )


def count_by(df: DataFrame, group: str, label: str = schema.LABEL) -> DataFrame:
    """Rows by two keys."""
    kept = df.dropna(subset=[group, label])
    return kept.groupBy(F.col(group).alias("segment"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_map(df: DataFrame, column: str, mapping: dict, out: str) -> DataFrame:
    """Recode values; what the mapping does not name becomes null (E5)."""
    recoded = F.lit(None).cast("string")
    for value, text in mapping.items():
        recoded = F.when(F.col(column) == value, text).otherwise(recoded)
    return df.withColumn(out, recoded)


def _long(df: DataFrame, keep: list, columns: list[str], name: str, value: str) -> DataFrame:
    texts = [F.col(c).cast("string").alias(f"_v_{c}") for c in columns]
    long = df.select(*keep, *texts).unpivot(
        [c for c in keep], [f"_v_{c}" for c in columns], name, value
    )
    return long.withColumn(name, F.expr(f"substring(`{name}`, 4)")).where(F.col(value).isNotNull())


def crosstab_pct(
    df: DataFrame, columns: list[str], label: str = schema.LABEL, labels=("No", "Yes")
) -> DataFrame:
    """Percent of each label per value of every column, all columns at once.

    A label that never occurs with a value has no cell: null, not 0.
    """
    cells = [F.nullif(F.count_if(F.col(label) == v), F.lit(0)) for v in labels]
    counted = _long(df, [label], columns, "variable", "value").dropna(subset=[label])
    counted = counted.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(f"_c{i}") for i, c in enumerate(cells)]
    )
    percents = [
        (100.0 * F.col(f"_c{i}") / F.col("n")).alias(f"pct_{str(v).lower()}")
        for i, v in enumerate(labels)
    ]
    return counted.select("variable", "value", "n", *percents)


def churner_heatmap(df: DataFrame, contracts: list[str] | None = None) -> DataFrame:
    """Churners by tenure bucket and contract, wide, empty cells 0.

    Contracts that are not listed, and null, count under ``other``.
    """
    contracts = contracts or schema.CONTRACTS
    group = tenure_bucket(F.col("tenure"), TENURE_LABELS)
    tests = [F.col("Contract") == c for c in contracts]
    tests.append(~F.coalesce(F.col("Contract").isin(contracts), F.lit(False)))
    names = [*contracts, "other"]
    cells = [
        F.count_if((group == g) & test).alias(f"_{i}_{j}")
        for i, g in enumerate(TENURE_LABELS)
        for j, test in enumerate(tests)
    ]
    counted = df.where(_churned()).agg(*cells)
    rows = [
        F.struct(
            F.lit(g).alias("tenure_group"),
            *[F.col(f"_{i}_{j}").alias(c) for j, c in enumerate(names)],
        )
        for i, g in enumerate(TENURE_LABELS)
    ]
    return counted.select(F.inline(F.array(*rows)))


def service_rates(
    df: DataFrame, services: list[str] | None = None, label: str = schema.LABEL, positive="Yes"
) -> DataFrame:
    """Churn rate and size per service value, without the "no service" values."""
    services = [c for c in (services or schema.SERVICE_COLUMNS) if c in df.columns]
    long = _long(df, [label], services, "service", "value")
    long = long.where(~F.col("value").isin(schema.NOT_SUBSCRIBED))
    return long.groupBy("service", "value").agg(
        _rate(_churned(label, positive)).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def hierarchy_counts(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Counts of a two-level hierarchy: leaves, and parents as the sum of theirs.

    The table is counted once by both keys; only those few rows are rolled up.
    """
    leaves = df.dropna(subset=[parent, child]).groupBy(parent, child).agg(
        F.count(F.lit(1)).alias("c")
    )
    rolled = leaves.rollup(parent, child).agg(F.grouping_id().alias("g"), F.sum("c").alias("n"))
    return rolled.where("g < 3").select(
        (2 - F.col("g")).cast("int").alias("depth"),
        F.col(parent).alias("parent"),
        F.col(child).alias("child"),
        "n",
    )


def risk_segment_masks() -> dict[str, Column]:
    """The five segments of the risk funnel; the last three sit side by side."""
    monthly = F.col("Contract") == "Month-to-month"
    fiber = monthly & (F.col("InternetService") == "Fiber optic")
    return {
        "monthly contract": monthly,
        "+ fiber": fiber,
        "+ senior": fiber & (F.col("SeniorCitizen") == 1),
        "+ electronic check": fiber & (F.col("PaymentMethod") == "Electronic check"),
        "+ under 12 months": fiber & (F.col("tenure") < 12),
    }


def risk_segments(df: DataFrame, segments: dict[str, Column] | None = None) -> DataFrame:
    """Size, churn rate and churners of each segment, in one scan."""
    segments = segments or risk_segment_masks()
    aggregates = []
    for i, mask in enumerate(segments.values()):
        aggregates.append(F.count_if(mask).alias(f"_n{i}"))
        aggregates.append(F.count_if(mask & _churned()).alias(f"_c{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("segment"),
            F.col(f"_n{i}").alias("n_clients"),
            ratio(F.col(f"_c{i}"), F.col(f"_n{i}")).alias("churn_rate"),
            F.col(f"_c{i}").alias("n_churners"),
        )
        for i, name in enumerate(segments)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def filter_in(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows whose columns hold allowed values; an empty list allows nothing."""
    for column, values in allowed.items():
        df = df.where(F.col(column).isin(values))
    return df


def is_empty(df: DataFrame) -> DataFrame:
    """One row: whether the table has no row; stops at the first one found."""
    return df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") == 0).alias("is_empty"))


def rate_by_tenure_group(df: DataFrame) -> DataFrame:
    """Churn percentage per tenure bucket; clients of month 0 belong to none."""
    bucket = tenure_bucket(F.col("tenure"), TENURE_LABELS_MONTHS, include_lowest=False)
    banded = df.select(bucket.alias("tenure_group"), schema.LABEL).dropna(subset=["tenure_group"])
    return banded.groupBy("tenure_group").agg(
        F.count(F.lit(1)).alias("n"), (100 * _rate(_churned())).alias("churn_pct")
    )


def rate_by_value(df: DataFrame, column: str, label: str, positive=1) -> DataFrame:
    """Percent of positives per value of a column."""
    return df.dropna(subset=[column]).groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), (100 * _rate(_churned(label, positive))).alias("pct")
    )


def rate_by_num_services(df: DataFrame) -> DataFrame:
    return rate_by_value(add_num_services(df), "num_services", schema.LABEL, "Yes")


def headline(df: DataFrame) -> DataFrame:
    """Overall churn percentage, four segments, and the mean churner."""

    def pct(mask: Column) -> Column:
        return 100 * ratio(F.count_if(mask & _churned()), F.count_if(mask))

    return df.agg(
        pct(F.lit(True)).alias("churn_pct"),
        pct(F.col("Contract") == "Month-to-month").alias("churn_pct_monthly"),
        pct(F.col("InternetService") == "Fiber optic").alias("churn_pct_fiber"),
        pct(F.col("OnlineSecurity") == "No").alias("churn_pct_no_security"),
        pct(F.col("SeniorCitizen") == 1).alias("churn_pct_senior"),
        F.avg(F.when(_churned(), F.col("tenure"))).alias("mean_tenure_churned"),
        F.avg(F.when(_churned(), F.col("MonthlyCharges"))).alias("mean_monthly_churned"),
    )
