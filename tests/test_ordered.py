"""Running totals, quantiles, splits and joins agree with the naive global form."""

import statistics
from functools import partialmethod

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbline.operators import distributions, ordered, splits
from ebbline.operators.curves import cumulative_gain
from ebbline.operators.ordered import (
    approximate_quantiles,
    exact_quantiles,
    global_positions,
    running_totals,
)
from ebbline.sources import staging

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def hot_rows(spark, n=30_000):
    """A third of all rows share one score, in two models of very different score ranges."""
    return spark.range(n).selectExpr(
        "string(id) AS id",
        "IF(id % 5 = 0, 'small', 'large') AS model",
        "IF(id % 3 = 0, 0.25D, pmod(hash(id), 977) / IF(id % 5 = 0, 1e6D, 10D)) AS score",
        "int(pmod(hash(id, 7), 4) = 0) AS label",
    )


def test_gain_over_a_hot_score(spark):
    rows = hot_rows(spark)
    order = Window.partitionBy("model").orderBy(
        F.desc("score"), F.md5(F.concat("id", F.lit(":42")).cast("binary")), "id"
    )
    whole = Window.partitionBy("model")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    naive = rows.select(
        "model",
        "id",
        F.row_number().over(order).cast("bigint").alias("position"),
        (F.sum("label").over(up_to) / F.sum("label").over(whole)).alias("gain"),
    )
    ours = cumulative_gain(rows).drop("taken")
    assert ours.count() == naive.count()
    assert ours.exceptAll(naive).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_cells_equal_one_window(spark, descending):
    rows = hot_rows(spark).groupBy("model", "score").agg(F.count(F.lit(1)).alias("c"))
    options = {"by": ["model"], "order": "score", "measures": ["c"], "descending": descending}
    cells = running_totals(rows, cell_rows=7, **options)
    window = running_totals(rows, cell_rows=10**9, **options)
    unstaged = running_totals(rows, staged=False, **options)
    assert cells.count() == window.count() == rows.count()
    assert cells.exceptAll(window).count() == 0 and unstaged.exceptAll(window).count() == 0


def test_cells_are_cut_again(spark, monkeypatch):
    """With four parts a cut, 30,000 rows take several levels; a hot value is cut by its hash."""
    monkeypatch.setattr(ordered, "FAN", 4)
    monkeypatch.setattr(ordered, "MOST_CELLS", 512)
    rows = hot_rows(spark)
    placed, totals = ordered._in_cells(
        rows.withColumns({"_key": F.col("score"), "_h": ordered.tie_hash(F.col("id"))}), ["model"], "_h", {}, 100
    )
    assert totals.agg(F.max("_n")).first()[0] < 400 and totals.agg(F.sum("_n")).first()[0] == 30_000
    low, high = Window.partitionBy("model").orderBy("_cell"), ["model", "_cell"]
    spans = placed.groupBy(*high).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    assert spans.withColumn("before", F.lag("hi").over(low)).where("before > lo").count() == 0
    probs = [0.0, 0.1, 0.5, 0.503, 1.0]
    deep = exact_quantiles(rows, ["model"], "score", probs, cell_rows=20)
    assert deep.exceptAll(exact_quantiles(rows, ["model"], "score", probs, cell_rows=10**9)).count() == 0


def test_ranks_share_ties_across_cells(spark):
    rows = hot_rows(spark, 3000).withColumn("score", F.when(F.col("id") % 50 != 7, F.col("score")))
    naive = rows.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.desc("score"))).cast("bigint"))
    naive = naive.withColumn("rank", F.when(F.col("score").isNotNull(), F.col("rank")))
    for size in (7, 10**9):
        ours = ordered.ranks(rows, ["model"], "score", descending=True, cell_rows=size)
        assert ours.count() == 3000 and ours.select(naive.columns).exceptAll(naive).count() == 0


def test_next_row_across_cells(spark):
    rows = hot_rows(spark, 2000).groupBy("model", "score").agg(F.count(F.lit(1)).alias("c"))
    ours = running_totals(rows, ["model"], "score", ["c"], following=["c"], cell_rows=7)
    naive = rows.withColumn("next_c", F.lead("c").over(Window.partitionBy("model").orderBy("score")))
    assert ours.count() == rows.count() and ours.select(naive.columns).exceptAll(naive).count() == 0


def test_box_stats_read_only_cut_cells(spark, monkeypatch):
    rows = hot_rows(spark, 6000).withColumn("score", F.col("score") + F.when(F.col("id") % 97 == 0, 5000).otherwise(0))
    one = distributions.box_stats(rows, "score", ["model"])
    read = []
    values = ordered.CellIndex.values
    monkeypatch.setattr(ordered.CellIndex, "__init__", partialmethod(ordered.CellIndex.__init__, cell_rows=40))
    monkeypatch.setattr(ordered.CellIndex, "values", lambda self, wanted, *a: read.append(wanted.count()) or values(self, wanted, *a))
    cells = distributions.box_stats(rows, "score", ["model"])
    assert cells.exceptAll(one).count() == 0 and cells.count() == 2
    assert read[-1] <= 4


def test_running_maximum(spark):
    rows = hot_rows(spark).selectExpr("model AS study", "int(id) AS trial", "score")
    options = {"by": ["study"], "order": "trial", "measures": ["score"], "how": "max"}
    cells = running_totals(rows, cell_rows=7, **options)
    window = running_totals(rows, cell_rows=10**9, **options)
    assert cells.exceptAll(window).count() == 0


def test_quantiles_of_a_large_group(spark):
    rows = hot_rows(spark)
    ours = {r["model"]: r for r in exact_quantiles(rows, ["model"], "score", [0.1, 0.5, 0.9]).collect()}
    builtin = rows.groupBy("model").agg(F.percentile("score", [0.1, 0.5, 0.9]).alias("q"))
    for row in builtin.collect():
        mine = ours[row["model"]]
        assert [mine["q0"], mine["q1"], mine["q2"]] == pytest.approx(row["q"], abs=1e-12)


def test_sketched_quantiles_are_close(spark):
    rows = spark.range(20_000).selectExpr("id % 2 AS g", "double(id) AS v")
    for row in approximate_quantiles(rows, ["g"], "v", [0.5]).collect():
        assert row["n"] == 10_000 and abs(row["q0"] - 10_000) < 400


def test_empty_and_null_input(spark):
    nothing = hot_rows(spark, 10).where("id < 0")
    assert exact_quantiles(nothing, ["model"], "score", [0.5]).count() == 0
    assert exact_quantiles(nothing, [], "score", [0.5]).first()["q0"] is None
    assert approximate_quantiles(nothing, [], "score", [0.5]).first()["q0"] is None
    assert cumulative_gain(nothing).count() == 0


def test_quantiles_by_cells_equal_one_cell(spark):
    rows = hot_rows(spark, 5000)
    probs = [0.0, 0.01, 0.33, 0.5, 0.77, 1.0]
    one = exact_quantiles(rows, ["model"], "score", probs)
    cells = exact_quantiles(rows, ["model"], "score", probs, cell_rows=7)
    assert cells.count() == 2 and cells.exceptAll(one).count() == 0
    flat = exact_quantiles(rows, [], "score", probs, cell_rows=7).first()
    builtin = rows.agg(F.percentile("score", probs).alias("q")).first()["q"]
    assert [flat[f"q{i}"] for i in range(len(probs))] == pytest.approx(builtin, abs=1e-12)


@QUICK
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_median_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantiles(df, [], "v", [0.5]).first()["q0"] == pytest.approx(statistics.median(values))


def test_global_positions(spark):
    df = spark.range(5000).selectExpr("string(id) AS s")
    placed = global_positions(df, ["s"]).withColumn("naive", F.row_number().over(Window.orderBy("s")) - 1)
    assert placed.where("position <> naive").count() == 0


def churners(spark, no, yes):
    return spark.range(no + yes).selectExpr("string(id) AS customerID", f"IF(id < {no}, 'No', 'Yes') AS Churn")


def test_split_sizes_of_the_published_labels(spark):
    split = splits.stratified_split(churners(spark, 5174, 1869))
    got = {(r["Churn"], r["split"]): r["count"] for r in split.groupBy("Churn", "split").count().collect()}
    assert got == {("No", "test"): 1035, ("No", "train"): 4139, ("Yes", "test"): 374, ("Yes", "train"): 1495}
    train = split.where("split = 'train'").selectExpr("int(Churn = 'Yes') AS Churn")
    row = splits.imbalance_ratio(train).first()
    assert (row["negatives"], row["positives"]) == (4139, 1495)
    assert row["ratio"] == pytest.approx(2.7686, abs=1e-4)


@pytest.mark.parametrize("k", [3, 5])
def test_folds_equal_the_naive_ranks(spark, k):
    rows = churners(spark, 1001, 7)
    folds = splits.stratified_folds(rows, k=k)
    order = Window.partitionBy("Churn").orderBy(splits.order_hash("customerID", 42), "customerID")
    size = F.count(F.lit(1)).over(Window.partitionBy("Churn"))
    naive = F.floor((F.row_number().over(order) - 1) * k / size)
    assert folds.withColumn("naive", naive).where("fold <> naive").count() == 0
    assert folds.count() == 1008 and folds.where("fold IS NULL").count() == 0


def test_more_folds_than_rows(spark):
    folds = splits.stratified_folds(churners(spark, 2, 1), k=5)
    assert folds.count() == 3 and folds.where("fold BETWEEN 0 AND 4").count() == 3


def test_small_class_and_null_label_survive_a_split(spark):
    rows = churners(spark, 50, 1).unionByName(spark.createDataFrame([("x", None)], "customerID string, Churn string"))
    split = splits.stratified_split(rows)
    assert split.count() == 52
    assert split.where("Churn IS NULL AND split IS NULL").count() == 1
    assert split.where("Churn = 'Yes' AND split = 'train'").count() == 1


def test_split_does_not_depend_on_partitions(spark):
    rows = churners(spark, 300, 100)
    one = splits.stratified_split(rows.coalesce(1))
    many = splits.stratified_split(rows.repartition(17))
    assert one.exceptAll(many).count() == 0


def test_attach_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    stats = staging.stage(rows.groupBy("k").agg(F.max("v").alias("top")).where("k < 500"))
    for how in ("inner", "left"):
        small = staging.attach(rows, stats, ["k"], how).select("k", "v", "top")
        monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 3)
        salted = staging.attach(rows, stats, ["k"], how).select("k", "v", "top")
        monkeypatch.undo()
        assert salted.count() == small.count() and salted.exceptAll(small).count() == 0


@QUICK
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=50), st.integers(1, 9))
def test_histogram_counts_every_value(spark, values, bins):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = distributions.histogram(df, "v", ["g"], bins).agg(F.sum("n"), F.count("*")).first()
    present = sum(v is not None for v in values)
    assert (got[0] or 0) == present and got[1] == (bins if present else 0)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("g", 2.0)] * 5, "g string, v double")
    rows = distributions.histogram(df, "v", ["g"], 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 5, 0]
    assert (rows[0]["bin_from"], rows[-1]["bin_to"]) == (1.5, 2.5)


def test_density_sums_to_one(spark, accounts):
    points = distributions.density(accounts, "MonthlyCharges", ["Churn"], grid=200, cut=5)
    for group in ("Yes", "No"):
        rows = sorted((r["x"], r["density"]) for r in points.where(F.col("Churn") == group).collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:]))
        assert area == pytest.approx(1, abs=1e-3)


def test_box_plot_of_known_values(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100)], "g string, v double")
    box = distributions.box_stats(df, "v", ["g"]).first()
    assert (box["p25"], box["p50"], box["p75"]) == (3.25, 5.5, 7.75)
    assert (box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (1.0, 9.0, 1)
    assert [r["value"] for r in distributions.box_outliers(df, "v", ["g"], []).collect()] == [100.0]


def test_points_skip_scores_without_labels(spark):
    from ebbline.operators.curves import average_precision, pr_points, roc_points

    rows = [("m", 0.9, None), ("m", 0.8, 1), ("m", 0.5, 0), ("m", 0.4, None)]
    scored = spark.createDataFrame(rows, "model string, score double, label int")
    known = scored.where("label is not null")
    for curve in (roc_points, pr_points, average_precision):
        assert sorted(map(str, curve(scored).collect())) == sorted(map(str, curve(known).collect()))


def test_attach_spreads_equal_rows(spark, monkeypatch):
    from ebbline.sources import staging

    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([("a", 1)] * 5000, "k string, v int")
    joined = staging.attach(rows, staging.stage(spark.createDataFrame([("a", 2)], "k string, w int")), ["k"])
    assert joined.count() == 5000 and joined.agg({"w": "max"}).first()[0] == 2


def test_wider_latin_range(spark):
    from pyspark.sql import functions as F

    from ebbline.functions.text import OUTSIDE_WIDER_LATIN, clean_display

    one = spark.createDataFrame([("- Việt ẞ ☂",)], "t string")
    assert one.select(clean_display(F.col("t"), OUTSIDE_WIDER_LATIN)).first()[0] == "Việt ẞ"


def test_staged_tables_can_be_removed(spark, tmp_path):
    made = staging._MADE.pop(spark.sparkContext.applicationId, [])
    before = spark.conf.get("spark.checkpoint.dir", None)
    spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    try:
        kept = staging.stage(spark.range(5))
        staging.new_path(spark, "never-written")
        assert kept.count() == 5 and len(list((tmp_path / "ebbline").iterdir())) == 1
        assert staging.remove_staged(spark) == 1 and not list((tmp_path / "ebbline").iterdir())
    finally:
        staging._MADE[spark.sparkContext.applicationId] = made
        spark.conf.unset("spark.checkpoint.dir") if before is None else spark.conf.set("spark.checkpoint.dir", before)
