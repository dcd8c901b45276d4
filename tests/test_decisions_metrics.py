import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbline.operators import curves, decisions, metrics
from ebbline.plans import models, tuning

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
SCORED = "id string, model string, label int, score double, prediction int"

# A sample profile of a client at risk.
CLIENT = {
    "Contract": "Month-to-month", "MonthlyCharges": 85.70, "tenure": 3, "TechSupport": "No",
    "OnlineSecurity": "No", "PaymentMethod": "Electronic check",
}
SAFE = {
    "Contract": "Two year", "MonthlyCharges": 20.0, "tenure": 60, "TechSupport": "Yes",
    "OnlineSecurity": "Yes", "PaymentMethod": "Mailed check",
}


def scored(spark, rows, model="m"):
    data = [(str(i), model, y, float(s), int(s >= 0.5)) for i, (y, s) in enumerate(rows)]
    return spark.createDataFrame(data, SCORED)


def advice(spark, profile, score):
    fields = "Contract string, MonthlyCharges double, tenure int, TechSupport string, OnlineSecurity string, PaymentMethod string, score double"
    df = spark.createDataFrame([(*profile.values(), score)], fields)
    return decisions.recommendations(df).first()["advice"]


def test_advice_in_fixed_order(spark):
    assert advice(spark, CLIENT, 0.9) == [
        "annual_contract", "price_bundle", "welcome_program", "tech_support", "online_security",
        "automatic_payment",
    ]


@pytest.mark.parametrize(
    "field, value, code",
    [
        ("Contract", "Month-to-month", "annual_contract"),
        ("MonthlyCharges", 70.01, "price_bundle"),
        ("tenure", 11, "welcome_program"),
        ("TechSupport", "No", "tech_support"),
        ("OnlineSecurity", "No", "online_security"),
        ("PaymentMethod", "Electronic check", "automatic_payment"),
    ],
)
def test_each_rule_alone(spark, field, value, code):
    assert advice(spark, {**SAFE, field: value}, 0.4) == [code]


def test_special_advice(spark):
    assert advice(spark, CLIENT, 0.39) == ["keep_quality"]
    assert advice(spark, SAFE, 0.9) == ["call_client"]
    assert advice(spark, {**SAFE, "MonthlyCharges": 70.0, "tenure": 12}, 0.9) == ["call_client"]


def test_absent_fields_use_defaults(spark):
    bare = spark.createDataFrame([(0.9,)], "score double")
    expected = ["welcome_program", "tech_support", "online_security"]
    assert decisions.recommendations(bare).first()["advice"] == expected


def test_every_code_has_a_text(spark):
    df = spark.createDataFrame([(*CLIENT.values(), 0.9)], ", ".join(
        f"{c} {'double' if c == 'MonthlyCharges' else 'int' if c == 'tenure' else 'string'}" for c in CLIENT
    ) + ", score double")
    assert None not in decisions.recommendations(df).first()["advice_text"]


def test_risk_boundaries(spark):
    df = spark.createDataFrame([(0.70,), (0.6999,), (0.40,), (0.3999,), (None,)], "score double")
    levels = [r["risk_level"] for r in decisions.add_risk_level(df).collect()]
    assert levels == ["high", "moderate", "moderate", "low", None]


def test_high_risk_is_strict(spark):
    df = scored(spark, [(1, 0.70), (1, 0.71), (0, 0.2)]).withColumn("tenure", F.lit(4))
    row = decisions.high_risk_profile(df, ["tenure"]).first()
    assert (row["n_high"], row["n_all"], row["churn_pct"], row["mean_tenure"]) == (1, 3, 100.0, 4.0)
    none = decisions.high_risk_profile(df, ["tenure"], threshold=0.99).first()
    assert none["churn_pct"] is None and none["mean_tenure"] is None


def test_clean_text(spark):
    df = spark.createDataFrame([("  — - Déjà \U0001F600vu \t",), ("✓",), (None,)], "t string")
    got = [r["t"] for r in decisions.clean_text(df, "t").collect()]
    assert got == ["Déjà vu", "", None]


def test_no_predicted_positive(spark):
    row = metrics.metrics(scored(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 0.5)


def test_tied_scores_and_single_class(spark):
    assert curves.roc_auc(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5)])).first()["roc_auc"] == 0.5
    assert curves.roc_auc(scored(spark, [(1, 0.5), (1, 0.6)])).first()["roc_auc"] is None
    assert metrics.metrics(scored(spark, [])).count() == 0


def test_known_curves(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    points = {(r["fpr"], r["tpr"]) for r in curves.roc_points(df).collect()}
    assert points == {(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)}
    assert curves.roc_auc(df).first()["roc_auc"] == 0.75
    row = curves.average_precision(df).first()
    assert row["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert row["baseline"] == 0.5
    assert {(r["recall"], r["precision"]) for r in curves.pr_points(df).collect()} >= {(0, 1), (1, 0.5)}


def test_rounded_scores_bound_the_points(spark):
    df = scored(spark, [(i % 2, i / 1000) for i in range(1000)])
    assert curves.roc_points(df, decimals=1).count() <= 12


def test_gain_of_one_row(spark):
    row = curves.cumulative_gain(scored(spark, [(1, 0.9)])).first()
    assert (row["position"], row["taken"], row["gain"]) == (1, 0.0, 1.0)


def test_best_threshold_takes_the_first_tie(spark):
    row = metrics.best_threshold(scored(spark, [(1, 0.9), (0, 0.05)])).first()
    assert (row["threshold"], row["f1"]) == (0.1, 1.0)


def test_thresholds_above_every_score(spark):
    rows = metrics.threshold_sweep(scored(spark, [(1, 0.3), (0, 0.2)])).collect()
    assert len(rows) == 16 and {r["recall"] for r in rows if r["threshold"] > 0.3} == {0.0}


@QUICK
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=2, max_size=40))
def test_auc_properties(spark, rows):
    df = scored(spark, [(y, s / 12) for y, s in rows])
    row = curves.roc_auc(df).first()["roc_auc"]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    if not pos or not neg:
        assert row is None
        return
    pairs = [(p > n) + 0.5 * (p == n) for p in pos for n in neg]
    assert row == pytest.approx(sum(pairs) / len(pairs))
    stretched = df.withColumn("score", F.exp(3 * F.col("score")))
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert curves.roc_auc(stretched).first()["roc_auc"] == pytest.approx(row)
    assert curves.roc_auc(flipped).first()["roc_auc"] == pytest.approx(1 - row)
    assert metrics.confusion_matrix(df).agg(F.sum("n")).first()[0] == len(rows)


def test_soft_vote(spark):
    both = scored(spark, [(1, 0.9), (0, 0.2)], "a").unionByName(scored(spark, [(1, 0.3), (0, 0.8)], "b"))
    got = {r["id"]: (r["score"], r["prediction"]) for r in models.soft_vote(both).collect()}
    assert got["0"] == (pytest.approx(0.6), 1) and got["1"] == (pytest.approx(0.5), 0)


def test_refine_grid():
    grid = tuning.refine_grid({"maxDepth": 3, "stepSize": 0.1})
    assert grid["maxDepth"] == [3, 3, 4] and grid["stepSize"] == [0.05, 0.1, 0.2]
    assert len(tuning.grid_points(tuning.refine_grid())) == 27
    assert len(tuning.grid_points(tuning.GRID)) == 8


def test_draws_are_repeatable_and_in_range():
    one, two = (tuning.draw_params(tuning.SPACE_A, 50, 42) for _ in range(2))
    assert one == two
    assert all(100 <= p["maxIter"] <= 499 and 0.01 <= p["stepSize"] <= 0.3 for p in one)
    logs = [math.log(p["stepSize"]) for p in tuning.draw_params(tuning.SPACE_A, 2000, 1)]
    assert sum(logs) / len(logs) == pytest.approx((math.log(0.01) + math.log(0.3)) / 2, abs=0.1)


def test_trial_ranks_share_ties(spark):
    rows = [("s", 0, 0.5), ("s", 1, 0.7), ("s", 2, 0.7), ("s", 3, None), ("t", 0, 0.9)]
    df = spark.createDataFrame(rows, "study string, trial int, score double")
    got = {(r["study"], r["trial"]): r["rank"] for r in tuning.rank_trials(df).collect()}
    assert got == {("s", 0): 3, ("s", 1): 1, ("s", 2): 1, ("s", 3): None, ("t", 0): 1}
