"""From a score to a decision, a risk level and retention advice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.expressions import HIGH_RISK, MODERATE_RISK, ratio, risk_level
from ebbline.functions.text import clean_display

# Advice codes in the order they are given, with a text for display.
ADVICE = {
    "keep_quality": "Loyal client. Keep up the current quality of service.",
    "annual_contract": "Offer a yearly contract with 10-15% off.",
    "price_bundle": "Offer a lower price or a better bundle.",
    "welcome_program": "Loyalty program for clients in their first year.",
    "tech_support": "Offer the technical support service.",
    "online_security": "Switch on online security.",
    "automatic_payment": "Encourage automatic payment.",
    "call_client": "Call the client for a satisfaction interview.",
}
HIGH_CHARGE = 70
FIRST_YEAR = 12


def add_risk_level(df: DataFrame, score: str = "score", out: str = "risk_level") -> DataFrame:
    """high / moderate / low."""
    return df.withColumn(out, risk_level(F.col(score)))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Decide again with another threshold."""
    return df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))


def decision_columns(score: Column, prediction: Column, model: Column) -> list[Column]:
    return [
        prediction.alias("prediction"),
        F.when(prediction == 1, "CHURN").otherwise("NO CHURN").alias("label"),
        score.alias("probability_churn"),
        (1 - score).alias("probability_no_churn"),
        risk_level(score).alias("risk_level"),
        model.alias("model_used"),
    ]


def score_profiles(scored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scored rows to the result record: class, text, both probabilities, risk."""
    columns = decision_columns(F.col("score"), F.col("prediction"), F.col("model"))
    return scored.select(*(keep or ["id"]), *columns)


def advice_codes(score: Column, columns: list[str]) -> Column:
    """Advice codes in fixed order; absent fields count as '', 0 or 'No'."""

    def text(name: str, default: str = "") -> Column:
        known = F.col(name).cast("string") if name in columns else F.lit(None)
        return F.coalesce(known, F.lit(default))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name) if name in columns else F.lit(None), F.lit(0))

    def without(name: str) -> Column:
        # Raw text, or the code of "No" on an encoded table.
        return text(name, "No").isin("No", "0")

    rules = [
        (text("Contract") == "Month-to-month", "annual_contract"),
        (number("MonthlyCharges") > HIGH_CHARGE, "price_bundle"),
        (number("tenure") < FIRST_YEAR, "welcome_program"),
        (without("TechSupport"), "tech_support"),
        (without("OnlineSecurity"), "online_security"),
        (text("PaymentMethod") == "Electronic check", "automatic_payment"),
    ]
    fired = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]))
    return (
        F.when(score < MODERATE_RISK, F.array(F.lit("keep_quality")))
        .when(F.size(fired) == 0, F.array(F.lit("call_client")))
        .otherwise(fired)
    )


def recommendations(df: DataFrame, score: str = "score") -> DataFrame:
    """Advice codes and their texts for every client (P5)."""
    texts = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    coded = df.withColumn("advice", advice_codes(F.col(score), df.columns))
    return coded.withColumn("advice_text", F.transform("advice", lambda c: texts[c]))


def recommendation_mix(df: DataFrame, score: str = "score") -> DataFrame:
    """How often each advice is given at each risk level."""
    given = df.select(
        risk_level(F.col(score)).alias("risk_level"),
        F.explode(advice_codes(F.col(score), df.columns)).alias("advice"),
    )
    return given.groupBy("risk_level", "advice").agg(F.count(F.lit(1)).alias("n"))


def clean_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Text made fit for display."""
    return df.withColumn(out or column, clean_display(F.col(column)))


def high_risk_profile(
    scored: DataFrame,
    features: list[str] | None = None,
    threshold: float = HIGH_RISK,
    by: list[str] | None = None,
) -> DataFrame:
    """Rows scored strictly above the threshold: size, share, true rate, mean profile."""
    features = features or ["tenure", "MonthlyCharges", "charges_per_tenure"]
    high = F.col("score") > threshold
    counted = scored.groupBy(*(by or ["model"])).agg(
        F.count_if(high).alias("n_high"),
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(high & (F.col("label") == 1)).alias("churned"),
        *[F.round(F.avg(F.when(high, F.col(c))), 2).alias(f"mean_{c}") for c in features],
    )
    return counted.select(
        *(by or ["model"]),
        "n_high",
        "n_all",
        (100 * ratio(F.col("n_high"), F.col("n_all"))).alias("pct_high"),
        (100 * ratio(F.col("churned"), F.col("n_high"))).alias("churn_pct"),
        *[f"mean_{c}" for c in features],
    )
