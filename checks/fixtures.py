"""Test inputs made from the given tables: a customer table, and scores from fixed points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema


def _digit(position: int) -> str:
    return f"substring(m, {position}, 1)"


def _addon(position: int, bound: str, name: str) -> str:
    taken = f"IF({_digit(position)} < '{bound}', 'Yes', 'No')"
    return f"IF(InternetService = 'No', 'No internet service', {taken}) AS {name}"


def accounts_from_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Deterministic customer table with a planted attrition signal.

    Every attribute is a function of the md5 digits of the customer key; the monthly charge
    follows the customer's mean order price. Orders are averaged before the join, so a
    customer with very many orders costs one row per input partition.
    """
    spend = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_price"))
    joined = customer.select("c_custkey").join(
        spend, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    hashed = joined.selectExpr(
        "string(c_custkey) AS customerID",
        "md5(string(c_custkey)) AS m",
        "round(18.25D + coalesce(avg_price, 0D) / 5000D, 2) AS MonthlyCharges",
    )
    base = hashed.selectExpr(
        "*",
        "int(int(conv(substring(m, 1, 2), 16, 10)) % 73) AS tenure",
        f"IF({_digit(4)} < '3', 1, 0) AS SeniorCitizen",
        f"IF({_digit(7)} < 'e', 'Yes', 'No') AS PhoneService",
        f"CASE WHEN {_digit(8)} < '7' THEN 'Fiber optic' WHEN {_digit(8)} < 'c' THEN 'DSL' "
        "ELSE 'No' END AS InternetService",
        f"CASE WHEN {_digit(9)} < '9' THEN 'Month-to-month' WHEN {_digit(9)} < 'c' THEN 'One year' "
        "ELSE 'Two year' END AS Contract",
        f"CASE WHEN {_digit(11)} < '5' THEN 'Electronic check' WHEN {_digit(11)} < '9' "
        f"THEN 'Mailed check' WHEN {_digit(11)} < 'd' THEN 'Bank transfer (automatic)' "
        "ELSE 'Credit card (automatic)' END AS PaymentMethod",
    )
    risk = (
        "1 + 3 * int(Contract = 'Month-to-month') + 2 * int(InternetService = 'Fiber optic') "
        "+ 3 * int(tenure < 12) + int(PaymentMethod = 'Electronic check') + SeniorCitizen"
    )
    return base.selectExpr(
        "customerID",
        f"IF({_digit(3)} < '8', 'Female', 'Male') AS gender",
        "SeniorCitizen",
        f"IF({_digit(5)} < '8', 'Yes', 'No') AS Partner",
        f"IF({_digit(6)} < '5', 'Yes', 'No') AS Dependents",
        "tenure",
        "PhoneService",
        f"IF(PhoneService = 'No', 'No phone service', IF({_digit(12)} < '7', 'Yes', 'No')) "
        "AS MultipleLines",
        "InternetService",
        _addon(13, "6", "OnlineSecurity"),
        _addon(14, "7", "OnlineBackup"),
        _addon(15, "7", "DeviceProtection"),
        _addon(16, "6", "TechSupport"),
        _addon(17, "8", "StreamingTV"),
        _addon(18, "8", "StreamingMovies"),
        "Contract",
        f"IF({_digit(10)} < '9', 'Yes', 'No') AS PaperlessBilling",
        "PaymentMethod",
        "MonthlyCharges",
        "IF(tenure = 0, ' ', string(round(tenure * MonthlyCharges, 2))) AS TotalCharges",
        f"IF(int(conv({_digit(20)}, 16, 10)) < {risk}, 'Yes', 'No') AS Churn",
    )


def _points(condition, weight):
    return F.when(condition, weight).otherwise(0)


def scorecard_scores(accounts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scored table ``(id, model, label, score, prediction)`` of two scorecards.

    Both models come out of one pass; ``keep`` carries account columns along.
    """
    monthly = F.col("Contract") == "Month-to-month"
    new = F.col("tenure") < 12
    card_a = (_points(monthly, 3) + _points(new, 3) + F.col("MonthlyCharges") / 200.0) / 8.0
    card_b = (
        _points(monthly, 3)
        + _points(F.col("InternetService") == "Fiber optic", 2)
        + _points(new, 3)
        + _points(F.col("PaymentMethod") == "Electronic check", 1)
        + F.col("SeniorCitizen")
    ).cast("double") / 10.0
    cards = [
        F.struct(F.lit(name).alias("model"), F.round(score, 2).alias("score"))
        for name, score in (("card_a", card_a), ("card_b", card_b))
    ]
    rows = accounts.select("*", F.inline(F.array(*cards)))
    return rows.select(
        F.col(schema.ID).alias("id"),
        "model",
        F.coalesce((F.col(schema.LABEL) == "Yes").cast("int"), F.lit(0)).alias("label"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("prediction"),
        *(keep or []),
    )
