"""Samples, histograms, box plots, densities and correlations."""

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.operators.ordered import CellIndex, approximate_quantiles, exact_quantiles
from ebbline.operators.splits import order_hash
from ebbline.sources.staging import attach, stage

QUARTILES = [0.25, 0.5, 0.75]
# Kernel widths beyond which a normal density is 0 in double precision.
REACH = 39.0


def plot_sample(
    df: DataFrame, n: int = 1000, seed: int = 42, identifier: str = schema.ID, columns=None
) -> DataFrame:
    """The ``n`` rows first in hash order: a reproducible sample for a plot.

    Each task keeps ``n`` candidates; the table is never sorted.
    """
    columns = columns or ["tenure", "MonthlyCharges", schema.LABEL]
    hashed = df.withColumn("_h", order_hash(identifier, seed))
    return hashed.orderBy("_h", identifier).limit(n).select(identifier, *columns)


def histogram(df: DataFrame, column: str, by: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over each group's own range, the maximum in the last bin.

    A group with a single value gets a range of one around it. Empty bins are listed.
    """
    values = df.dropna(subset=[*by, column]).select(*by, F.col(column).cast("double").alias("_v"))
    ranges = values.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    ranges = stage(ranges.withColumn("width", (F.col("hi") - F.col("lo")) / bins), "ranges")
    place = F.floor((F.col("_v") - F.col("lo")) / F.col("width")).cast("int")
    placed = attach(values, ranges, by).withColumn("bin", F.least(place, F.lit(bins - 1)))
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_from"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_to"),
        F.coalesce("c", F.lit(0)).cast("bigint").alias("n"),
    )


def _fenced(quartiles: DataFrame, by: list[str]) -> DataFrame:
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    fenced = quartiles.select(
        *by,
        "n",
        F.col("q0").alias("p25"),
        F.col("q1").alias("p50"),
        F.col("q2").alias("p75"),
        (F.col("q0") - reach).alias("fence_low"),
        (F.col("q2") + reach).alias("fence_high"),
    )
    return stage(fenced, "fences")


def _fences(df: DataFrame, column: str, by: list[str], approx: bool) -> DataFrame:
    quantiles = approximate_quantiles if approx else exact_quantiles
    return _fenced(quantiles(df, by, column, QUARTILES), by)


def box_stats(df: DataFrame, column: str, by: list[str], approx: bool = False) -> DataFrame:
    """Quartiles, Tukey whiskers (the furthest values inside the fences), outliers.

    The cells made for the quartiles answer for the fences too: a cell on one side of a fence
    counts as a whole, by its minimum, maximum and count. Only cells that a fence runs through
    are read again, at most two of a group.
    """
    index = CellIndex(df, by, column)
    fences = _fenced(approximate_quantiles(df, by, column, QUARTILES), by) if approx else _fenced(index.quantiles(QUARTILES), by)
    low, high = F.col("fence_low"), F.col("fence_high")
    cells = attach(index.cells, fences.select(*by, "fence_low", "fence_high"), by)
    cells = cells.withColumn("cut", (F.col("lo") < low) & (F.col("hi") >= low) | (F.col("lo") <= high) & (F.col("hi") > high))
    # One value is never cut, so what is read are ranges that hold a fence.
    inside = index.values(cells.where("cut").drop("fence_low", "fence_high", "cut"))
    inside = attach(inside, fences.select(*by, "fence_low", "fence_high"), by)
    ends = inside.select(*by, "fence_low", "fence_high", F.col("_key").alias("lo"), F.col("_key").alias("hi"), F.col("c").alias("_n"))
    parts = cells.where("not cut").select(ends.columns).unionByName(ends)
    within = (F.col("lo") >= low) & (F.col("hi") <= high)
    reach = parts.groupBy(*by).agg(
        F.min(F.when(within, F.col("lo"))).alias("_low"),
        F.max(F.when(within, F.col("hi"))).alias("_high"),
        F.coalesce(F.sum(F.when(~within, F.col("_n"))), F.lit(0)).alias("n_outliers"),
    )
    return fences.join(reach, by).select(
        *by,
        "n",
        "p25",
        "p50",
        "p75",
        F.least("_low", "p25").alias("whisker_low"),
        F.greatest("_high", "p75").alias("whisker_high"),
        "n_outliers",
    )


def box_outliers(
    df: DataFrame, column: str, by: list[str], identifier: list[str], approx: bool = False
) -> DataFrame:
    """The rows outside their group's fences."""
    fences = _fences(df, column, by, approx).select(*by, "fence_low", "fence_high")
    rows = attach(df.select(*dict.fromkeys([*identifier, *by, column])), fences, by)
    outside = (F.col(column) < F.col("fence_low")) | (F.col(column) > F.col("fence_high"))
    return rows.where(outside).select(*identifier, *by, F.col(column).alias("value"))


def density(
    df: DataFrame, column: str, by: list[str], grid: int = 100, cut: float = 2.0
) -> DataFrame:
    """Gaussian kernel density per group on ``grid`` points, Scott's-rule width.

    Exact: every distinct value, weighted by its count, contributes to every point at which its
    kernel isn't 0 in double precision. A value is expanded to the points in its reach only, and
    a point's sum is combined on the map side; points that no value reaches are listed with 0.
    The grid reaches ``cut`` widths beyond the range. A group with no spread or a single row has
    no width, hence no density.
    """
    values = (
        df.dropna(subset=[*by, column])
        .groupBy(*by, F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # The counted values serve twice: for the widths, and for the points.
    values = stage(values, "values")
    n, mean = F.sum("_c"), F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")
    centred = attach(values, stage(values.groupBy(*by).agg(mean.alias("mean")), "means"), by)
    spread = F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("mean"), 2))
    rows = centred.groupBy(*by).agg(
        n.alias("n"), spread.alias("spread"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    # A single row has no spread: null.
    sd = F.sqrt(F.try_divide("spread", F.col("n") - 1))
    widths = rows.withColumn("h", sd * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    widths = widths.where("h > 0").select(
        *by,
        "n",
        "h",
        (F.col("lo") - cut * F.col("h")).alias("x0"),
        ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1)).alias("step"),
    )
    widths = stage(widths, "widths")
    near = F.floor((F.col("_v") - REACH * F.col("h") - F.col("x0")) / F.col("step"))
    far = F.ceil((F.col("_v") + REACH * F.col("h") - F.col("x0")) / F.col("step"))
    reached = F.sequence(F.greatest(near, F.lit(0)).cast("int"), F.least(far, F.lit(grid - 1)).cast("int"))
    points = attach(values, widths, by).withColumn("point", F.explode(reached))
    x = F.col("x0") + F.col("point") * F.col("step")
    z = (x - F.col("_v")) / F.col("h")
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    share = F.col("_c") * F.exp(-0.5 * z * z) / norm
    summed = points.groupBy(*by, "point").agg(F.sum(share).alias("density"))
    whole = widths.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return whole.join(summed, [*by, "point"], "left").select(
        *by, "point", x.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density")
    )


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, rows with either value missing left out."""
    pairs = [(b, a) for a, b in combinations(columns, 2)]
    return _correlations(df, pairs).toDF("var_a", "var_b", "corr")


def label_correlation(df: DataFrame, columns: list[str], label: str = schema.LABEL) -> DataFrame:
    """Features by their correlation with a numeric label."""
    out = _correlations(df, [(c, label) for c in columns]).toDF("feature", "label", "corr")
    return out.select("feature", "corr").orderBy("corr", "feature")


def _correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    def pair(a, b):
        return F.corr(F.col(a).cast("double"), F.col(b).cast("double"))

    row = df.agg(*[pair(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    structs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*structs)))
