"""The customer ("accounts") table: schema, column roles and fixed values."""

from pyspark.sql import types as T

ID = "customerID"
LABEL = "Churn"

# Column names and category texts of the telecom customer table.
BINARY_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
CATEGORY_COLUMNS = [
    "gender", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaymentMethod",
]
SERVICE_COLUMNS = [
    "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
]
INTERNET_ADDONS = [
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies",
]
DEMOGRAPHIC_COLUMNS = ["gender", "SeniorCitizen", "Partner", "Dependents"]
PLAN_COLUMNS = ["Contract", "PaperlessBilling", "PaymentMethod"]
NUMERIC_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
INTERNET_TYPES = ["DSL", "Fiber optic", "No"]
NOT_SUBSCRIBED = ["No internet service", "No phone service"]

ACCOUNT_SCHEMA = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("SeniorCitizen", T.IntegerType()),
        T.StructField("Partner", T.StringType()),
        T.StructField("Dependents", T.StringType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("PhoneService", T.StringType()),
        T.StructField("MultipleLines", T.StringType()),
        T.StructField("InternetService", T.StringType()),
        T.StructField("OnlineSecurity", T.StringType()),
        T.StructField("OnlineBackup", T.StringType()),
        T.StructField("DeviceProtection", T.StringType()),
        T.StructField("TechSupport", T.StringType()),
        T.StructField("StreamingTV", T.StringType()),
        T.StructField("StreamingMovies", T.StringType()),
        T.StructField("Contract", T.StringType()),
        T.StructField("PaperlessBilling", T.StringType()),
        T.StructField("PaymentMethod", T.StringType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        # Text on purpose: new clients carry a blank, turned into null by coerce_numeric.
        T.StructField("TotalCharges", T.StringType()),
        T.StructField("Churn", T.StringType()),
    ]
)
ACCOUNT_COLUMNS = ACCOUNT_SCHEMA.fieldNames()

# The 19 raw features: everything but the key and the label, in table order.
RAW_FEATURES = [c for c in ACCOUNT_COLUMNS if c not in (ID, LABEL)]
LIBRARY_FEATURES = RAW_FEATURES + ["ChargesPerMonth", "TenureGroup", "TotalServices"]
NOTEBOOK_FEATURES = RAW_FEATURES + [
    "num_services", "charges_per_tenure", "senior_alone", "is_monthly_contract",
    "fiber_no_security",
]

# Churn rate the KPI row is compared with.
REFERENCE_CHURN_RATE = 0.265
