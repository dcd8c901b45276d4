"""Reproducible stratified splits and folds, and class weights.

Rows of a class are ordered by a hash of their key. A part of the class is then an interval
of that order, so placing a row is one comparison with a few cut points and moves no data;
only the rows of the hash buckets that hold a cut point are ever ranked.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import ratio
from ebbline.sources.staging import attach, stage

# Leading hex digits that form a bucket: 65,536 buckets per class.
BUCKET_DIGITS = 4


def order_hash(identifier: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(identifier).cast("string"), F.lit(f":{seed}")).cast("binary"))


def _place(identifier: str, seed: int) -> Column:
    return F.struct(order_hash(identifier, seed).alias("h"), F.col(identifier).alias("id"))


def rank_cuts(
    df: DataFrame,
    label: str,
    identifier: str,
    seed: int,
    ranks: Callable[[Column], Column],
) -> DataFrame:
    """Per class, the (hash, id) found at the 1-based ranks ``ranks(class size)``.

    Returns ``label, cuts`` with one row per class, staged.
    """
    keyed = df.select(label, _place(identifier, seed).alias("_p")).dropna(subset=[label])
    keyed = keyed.withColumn("_b", F.substring("_p.h", 1, BUCKET_DIGITS))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy(label).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sized = counts.withColumns(
        {"run": F.sum("c").over(up_to), "n": F.sum("c").over(Window.partitionBy(label))}
    )
    wanted = sized.withColumn("rank", F.explode(ranks(F.col("n")))).withColumn(
        "need", F.col("rank") - (F.col("run") - F.col("c"))
    )
    wanted = wanted.where("need BETWEEN 1 AND c")
    # At most one entry per class and rank.
    wanted = stage(wanted.groupBy(label, "_b").agg(F.collect_list("need").alias("needs")), "cuts")
    inside = Window.partitionBy(label, "_b").orderBy("_p")
    ranked = attach(keyed, wanted, [label, "_b"]).withColumn("_r", F.row_number().over(inside))
    hits = ranked.withColumn("_hit", F.explode(F.filter("needs", lambda x: x == F.col("_r"))))
    return stage(hits.groupBy(label).agg(F.sort_array(F.collect_list("_p")).alias("cuts")), "cuts")


def stratified_split(
    df: DataFrame,
    label: str = schema.LABEL,
    identifier: str = schema.ID,
    test_size: float = 0.2,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Exactly ``round(test_size x n)`` test rows of every class, the rest train."""

    def last_test_rank(n: Column) -> Column:
        return F.array(F.floor(n * F.lit(float(test_size)) + 0.5))

    cuts = rank_cuts(df, label, identifier, seed, last_test_rank)
    placed = attach(df, cuts, [label], "left")
    in_test = _place(identifier, seed) <= F.element_at("cuts", 1)
    part = F.when(F.col(label).isNull(), None).when(in_test, "test").otherwise("train")
    return placed.select(*df.columns, part.alias(out))


def stratified_folds(
    df: DataFrame,
    label: str = schema.LABEL,
    identifier: str = schema.ID,
    k: int = 5,
    seed: int = 42,
    out: str = "fold",
) -> DataFrame:
    """Fold 0 .. k-1 per row; every class is spread evenly, to within one row."""

    def last_ranks(n: Column) -> Column:
        return F.array(*[F.floor((n * j + (k - 1)) / F.lit(k)) for j in range(1, k)])

    cuts = rank_cuts(df, label, identifier, seed, last_ranks)
    placed = attach(df, cuts, [label], "left")
    passed = F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c < F.col("_p")))
    fold = F.when(F.col(label).isNotNull(), passed)
    return placed.withColumn("_p", _place(identifier, seed)).select(*df.columns, fold.alias(out))


def split_audit(df: DataFrame, label: str = schema.LABEL, split: str = "split") -> DataFrame:
    """Rows and label rate of each part and of the whole."""
    parts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    both = parts.rollup(split).agg(
        F.grouping(split).alias("whole"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_positive")
    )
    name = F.when(F.col("whole") == 1, "all").otherwise(F.col(split))
    return both.select(
        name.alias("part"),
        "n_rows",
        "n_positive",
        ratio(F.col("n_positive"), F.col("n_rows")).alias("label_rate"),
    )


def class_counts(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )


def imbalance_ratio(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """Negatives over positives."""
    ratio_column = ratio(F.col("negatives"), F.col("positives")).alias("ratio")
    return class_counts(df, label).select("negatives", "positives", ratio_column)


def class_weights(
    df: DataFrame, label: str = schema.LABEL, mode: str = "balanced", out: str = "weight"
) -> DataFrame:
    """Weight column (X5): n / (classes x class size), or the imbalance ratio on positives."""
    counts = class_counts(df, label).select(F.struct("*").alias("s")).scalar()
    neg, pos = F.col("_c.negatives"), F.col("_c.positives")
    own = F.when(F.col(label) == 1, pos).when(F.col(label) == 0, neg)
    if mode == "balanced":
        classes = (neg > 0).cast("int") + (pos > 0).cast("int")
        weight = ratio(neg + pos, classes * own)
    elif mode == "ratio":
        weight = F.when(F.col(label) == 1, ratio(neg, pos)).when(F.col(label) == 0, 1.0)
    else:
        raise ValueError("mode is 'balanced' or 'ratio'")
    return df.withColumn("_c", counts).withColumn(out, weight).drop("_c")
