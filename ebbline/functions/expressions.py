"""Column expressions shared by batch, streaming and model code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges (months) of the tenure buckets, and of the risk levels.
TENURE_EDGES = [12, 24, 48, 72]
TENURE_LABELS = ["0-12m", "12-24m", "24-48m", "48-72m"]
TENURE_LABELS_MONTHS = ["0-12 months", "13-24 months", "25-48 months", "49-72 months"]
HIGH_RISK = 0.70
MODERATE_RISK = 0.40


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def tenure_bucket(
    tenure: Column,
    labels: list | None = None,
    include_lowest: bool = True,
    open_ended: bool = False,
) -> Column:
    """Right-closed tenure buckets; codes 0..3 unless ``labels`` are given.

    Outside (0, 72] the result is null, but ``include_lowest`` lets 0 into the first bucket
    and ``open_ended`` sends everything below into the first and above into the last.
    """
    names = [F.lit(x) for x in (labels or [0, 1, 2, 3])]
    if open_ended:
        out = F.when(tenure <= TENURE_EDGES[0], names[0])
        out = out.when(tenure <= TENURE_EDGES[1], names[1]).when(tenure <= TENURE_EDGES[2], names[2])
        return out.when(tenure.isNotNull(), names[3])
    lowest = tenure >= 0 if include_lowest else tenure > 0
    out = F.when(lowest & (tenure <= TENURE_EDGES[0]), names[0])
    for low, high, name in zip(TENURE_EDGES, TENURE_EDGES[1:], names[1:]):
        out = out.when((tenure > low) & (tenure <= high), name)
    return out


def count_where(columns: list[str], test) -> Column:
    """How many of the columns pass ``test``; a null does not."""
    total = F.lit(0)
    for c in columns:
        total = total + flag(test(F.col(c)))
    return total


def risk_level(score: Column) -> Column:
    """high from .70, moderate from .40, else low."""
    return (
        F.when(score >= HIGH_RISK, "high")
        .when(score >= MODERATE_RISK, "moderate")
        .when(score.isNotNull(), "low")
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; null when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))
