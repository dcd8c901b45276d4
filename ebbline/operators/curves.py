"""ROC, precision-recall and gain curves.

Rows are first counted per distinct score; the running totals over scores, and over rows for
the gain curve, never gather a model in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.expressions import ratio
from ebbline.operators.ordered import running_totals, tie_hash


def score_totals(
    scored: DataFrame,
    by: list[str] | None = None,
    extra: list[Column] | None = None,
    decimals: int | None = None,
    following: bool = False,
) -> DataFrame:
    """Per distinct score: positives, negatives, and their running totals from the top.

    ``decimals`` rounds the scores first, for curves of a bounded number of points.
    ``following`` adds the counts at the next lower score, ``next_pos`` and ``next_neg``.
    """
    by = by or ["model"]
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    counts = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
        *(extra or []),
    )
    steps = ["pos", "neg"]
    return running_totals(counts, by, "score", steps, descending=True, following=steps if following else None)


def area_sum() -> Column:
    """ROC-AUC as an aggregate over ``score_totals``, ties counted half; null for one class."""
    above = F.col("run_pos").cast("double") - F.col("pos") / 2.0
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return F.try_divide(F.sum(F.col("neg") * above), pairs)


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve (V6)."""
    by = by or ["model"]
    return score_totals(scored, by).groupBy(*by).agg(area_sum().alias("roc_auc"))


def roc_points(
    scored: DataFrame, by: list[str] | None = None, decimals: int | None = None, thin: bool = False
) -> DataFrame:
    """A point per distinct score, and the start at (0, 0) with no threshold (V5).

    ``thin`` leaves out the points from which the curve goes on with the same step as it came:
    they lie on a straight line, so the drawn curve is the same. The first and the last stay.
    """
    by = by or ["model"]
    # A score whose labels are all null is no point, and must not look like the first one.
    totals = score_totals(scored.where("label in (0, 1)"), by, decimals=decimals, following=thin)
    first = (F.col("run_pos") == F.col("pos")) & (F.col("run_neg") == F.col("neg"))
    if thin:
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        totals = totals.where(first | F.col("next_pos").isNull() | turns)
    point = F.struct(
        ratio(F.col("run_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("run_pos"), F.col("all_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    start = F.struct(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    points = F.when(first, F.array(start, point)).otherwise(F.array(point))
    return totals.select(*by, F.inline(points))


def pr_points(
    scored: DataFrame, by: list[str] | None = None, decimals: int | None = None
) -> DataFrame:
    """Precision and recall per distinct score, and the end at recall 0, precision 1 (V7)."""
    by = by or ["model"]
    # A score whose labels are all null is no point, and must not look like the first one.
    totals = score_totals(scored.where("label in (0, 1)"), by, decimals=decimals)
    point = F.struct(
        ratio(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"),
        ratio(F.col("run_pos"), F.col("all_pos")).alias("recall"),
        F.col("score").alias("threshold"),
    )
    end = F.struct(
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    first = (F.col("run_pos") == F.col("pos")) & (F.col("run_neg") == F.col("neg"))
    points = F.when(first, F.array(end, point)).otherwise(F.array(point))
    return totals.select(*by, F.inline(points))


def average_precision(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Step sum of precision over recall, and the share of positives as baseline (V8)."""
    by = by or ["model"]
    step = F.col("pos").cast("double") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    pos, neg = F.max("all_pos"), F.max("all_neg")
    return score_totals(scored.where("label in (0, 1)"), by).groupBy(*by).agg(
        F.try_divide(F.sum(step), pos.cast("double")).alias("average_precision"),
        ratio(pos, pos + neg).alias("baseline"),
    )


def cumulative_gain(
    scored: DataFrame, by: list[str] | None = None, identifier: str = "id", seed: int = 42
) -> DataFrame:
    """Share of positives found against share of rows taken, best score first (V9).

    Equal scores are taken in hash order of the row id, so the curve can be repeated and one
    score shared by very many rows can be cut.
    """
    by = by or ["model"]
    rows = scored.select(
        *by,
        identifier,
        "score",
        F.col("label").cast("bigint").alias("pos"),
        F.lit(1).cast("bigint").alias("one"),
        tie_hash(F.concat(F.col(identifier).cast("string"), F.lit(f":{seed}"))).alias("_h"),
    )
    totals = running_totals(
        rows,
        by,
        "score",
        ["one", "pos"],
        descending=True,
        tie="_h",
        tie_break=[identifier],
        staged=False,
    )
    taken = F.coalesce(ratio(F.col("run_one") - 1, F.col("all_one") - 1), F.lit(0.0))
    return totals.select(
        *by,
        identifier,
        F.col("run_one").alias("position"),
        taken.alias("taken"),
        ratio(F.col("run_pos"), F.col("all_pos")).alias("gain"),
    )


def ideal_gain(
    scored: DataFrame, by: list[str] | None = None, identifier: str = "id", seed: int = 42
) -> DataFrame:
    """The gain curve of a model that scores by the label itself."""
    ideal = scored.withColumn("score", F.col("label").cast("double"))
    return cumulative_gain(ideal, by, identifier, seed)
