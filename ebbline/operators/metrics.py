"""Classification metrics over a scored table ``(id, model, label, score, prediction)``.

Every operator takes ``by``, the columns that name one evaluated run (model, or model and
fold, or model and split).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.expressions import or_zero, ratio
from ebbline.operators.curves import area_sum, score_totals
from ebbline.operators.distributions import box_stats

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
# Fixed values: .10, .15 .. .85.
THRESHOLDS = [i * 5 / 100.0 for i in range(2, 18)]


def _cells() -> list[Column]:
    """The four confusion counts."""
    y, p = F.col("label"), F.col("prediction")
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def _precision(tp: Column, fp: Column) -> Column:
    return or_zero(ratio(tp, tp + fp))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return or_zero(ratio(2 * tp, 2 * tp + fp + fn))


def confusion_cells(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or ["model"])).agg(*_cells())


def metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and ROC-AUC, one pass (V1)."""
    by = by or ["model"]
    totals = score_totals(scored, by, extra=_cells())
    summed = totals.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")], area_sum().alias("roc_auc")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return summed.select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _precision(tp, fp).alias("precision"),
        _precision(tp, fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        "roc_auc",
    )


def classification_report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means (V2)."""
    by = by or ["model"]
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    neg, pos, n = tn + fp, fn + tp, tn + fp + fn + tp
    no = [_precision(tn, fn), _precision(tn, fp), _f1(tn, fn, fp)]
    yes = [_precision(tp, fp), _precision(tp, fn), _f1(tp, fp, fn)]
    accuracy = or_zero(ratio(tp + tn, n))
    macro = [(a + b) / 2 for a, b in zip(no, yes)]
    weighted = [or_zero(ratio(a * neg + b * pos, n)) for a, b in zip(no, yes)]

    def row(name: str, values: list[Column], support: Column) -> Column:
        cells = [v.alias(m) for v, m in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("class"), *cells, support.alias("support"))

    rows = [
        row("0", no, neg),
        row("1", yes, pos),
        row("accuracy", [accuracy] * 3, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    ]
    return confusion_cells(scored, by).select(*by, F.inline(F.array(*rows)))


def confusion_matrix(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four counts as rows, zeros kept (V3)."""
    by = by or ["model"]
    rows = [
        F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
        for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return confusion_cells(scored, by).select(*by, F.inline(F.array(*rows)))


def confusion_pct(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each cell as percent of its true class and of all rows (V4)."""
    by = by or ["model"]
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    rows = [
        F.struct(
            F.lit(y).alias("label"),
            F.lit(p).alias("prediction"),
            F.col(c).alias("n"),
            (100 * ratio(F.col(c), size)).alias("pct_of_label"),
            (100 * ratio(F.col(c), neg + pos)).alias("pct_of_all"),
        )
        for y, p, c, size in (
            (0, 0, "tn", neg), (0, 1, "fp", neg), (1, 0, "fn", pos), (1, 1, "tp", pos)
        )
    ]
    return confusion_cells(scored, by).select(*by, F.inline(F.array(*rows)))


def threshold_sweep(
    scored: DataFrame, thresholds: list[float] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Precision, recall and F1 at each threshold, ``score >= t``.

    A row is counted once, under the number of thresholds it passes; the few counts are then
    summed from the top, so rows are never multiplied by thresholds.
    """
    by = by or ["model"]
    thresholds = sorted(thresholds or THRESHOLDS)
    passed = F.expr(" + ".join(f"coalesce(int(score >= {t!r}D), 0)" for t in thresholds))
    counted = scored.groupBy(*by, passed.alias("passed")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    # At most one counted row per run and number of thresholds passed.
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))))
    reached = F.col("passed") >= F.col("step")
    summed = steps.groupBy(*by, "step").agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("neg")).otherwise(0)).alias("fp"),
    )
    all_positives = F.max("tp").over(Window.partitionBy(*by))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    levels = F.array(*[F.lit(t) for t in thresholds])
    return summed.withColumn("fn", all_positives - tp).where("step > 0").select(
        *by,
        F.element_at(levels, F.col("step")).alias("threshold"),
        _precision(tp, fp).alias("precision"),
        _precision(tp, fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def best_threshold(
    scored: DataFrame, thresholds: list[float] | None = None, by: list[str] | None = None
) -> DataFrame:
    """The threshold with the highest F1, the lowest one on ties."""
    by = by or ["model"]
    swept = threshold_sweep(scored, thresholds, by)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold")))
    return swept.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def compare_models(scored: DataFrame, percent: bool = False) -> DataFrame:
    """Metrics of every model, best AUC first: 4 decimals, or percent with 1."""
    table = metrics(scored)
    if percent:
        shown = [F.round(100 * F.col(m), 1).alias(m) for m in METRICS]
    else:
        shown = [F.round(m, 4).alias(m) for m in METRICS]
    return table.select("model", *shown).orderBy(F.desc("roc_auc"), "model")


def best_per_metric(table: DataFrame) -> DataFrame:
    """The model with the highest value of each metric, first by name on ties."""
    long = table.unpivot(["model"], METRICS, "metric", "value").where(F.col("value").isNotNull())
    first = F.min_by("model", F.struct(-F.col("value"), F.col("model")))
    return long.groupBy("metric").agg(first.alias("model"), F.max("value").alias("value"))


def before_after(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Metrics of each model before and after tuning, and the gain."""
    stages = base.withColumn("stage", F.lit("base")).unionByName(
        tuned.withColumn("stage", F.lit("tuned"))
    )
    long = metrics(stages, ["model", "stage"]).unpivot(
        ["model", "stage"], METRICS, "metric", "value"
    )
    value = {s: F.max(F.when(F.col("stage") == s, F.col("value"))) for s in ("base", "tuned")}
    both = long.groupBy("model", "metric").agg(
        value["base"].alias("before"), value["tuned"].alias("after")
    )
    return both.withColumn("gain", F.col("after") - F.col("before"))


def fold_scores(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """AUC of every model in every fold."""
    return metrics(scored, ["model", fold]).select("model", fold, F.col("roc_auc").alias("score"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores of each model."""
    return scores.groupBy("model").agg(
        F.count("score").alias("n_folds"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def cv_box(scores: DataFrame) -> DataFrame:
    """Box-plot numbers of the fold scores."""
    return box_stats(scores, "score", ["model"])


def overfit_check(scored: DataFrame, split: str = "split", tolerance: float = 0.05) -> DataFrame:
    """AUC on train minus AUC on test, and whether it stays under the tolerance."""
    parts = metrics(scored, ["model", split])
    auc = {s: F.max(F.when(F.col(split) == s, F.col("roc_auc"))) for s in ("train", "test")}
    both = parts.groupBy("model").agg(auc["train"].alias("auc_train"), auc["test"].alias("auc_test"))
    gap = F.col("auc_train") - F.col("auc_test")
    return both.withColumn("gap", gap).withColumn("within_tolerance", F.col("gap") < tolerance)
