import pytest
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import tenure_bucket
from ebbline.operators import cleaning, encoding, features, profiling, scaling, segments
from ebbline.sources.accounts import read_accounts, write_accounts_csv

EDGES = [0, 1, 11, 12, 13, 24, 25, 48, 49, 72, 73, None]


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def tenures(spark):
    return spark.createDataFrame([(t,) for t in EDGES], "tenure int")


@pytest.mark.parametrize(
    "options, expected",
    [
        ({}, [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, None, None]),
        ({"include_lowest": False}, [None, 0, 0, 0, 1, 1, 2, 2, 3, 3, None, None]),
        ({"open_ended": True}, [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3, None]),
    ],
)
def test_tenure_edges(spark, options, expected):
    assert column(features.add_tenure_group(tenures(spark), **options), "TenureGroup") == expected


def test_tenure_labels_and_negative(spark):
    df = spark.createDataFrame([(-1,), (0,), (13,)], "t int")
    plain = df.select(tenure_bucket(F.col("t"), ["a", "b", "c", "d"]).alias("g"))
    assert column(plain, "g") == [None, "a", "b"]
    opened = df.select(tenure_bucket(F.col("t"), open_ended=True).alias("g"))
    assert column(opened, "g") == [0, 0, 1]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([(" ",), ("",), ("29.85",), ("abc",), (None,)], "TotalCharges string")
    assert column(cleaning.coerce_numeric(df), "TotalCharges") == [None, None, 29.85, None, None]


def test_median_of_even_count_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "TotalCharges double")
    assert sorted(column(cleaning.impute_median(df), "TotalCharges")) == [1.0, 2.0, 3.0, 4.0, 10.0]


def test_median_of_nothing_leaves_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "TotalCharges double")
    assert column(cleaning.impute_median(df), "TotalCharges") == [None, None]


def test_identifier_is_dropped_once(spark):
    df = spark.createDataFrame([("a", 1)], "customerID string, x int")
    once = cleaning.drop_identifier(df)
    assert once.columns == ["x"] and cleaning.drop_identifier(once).columns == ["x"]


def test_services_before_and_after_encoding(accounts):
    offline = accounts.where("InternetService = 'No' AND PhoneService = 'No'").limit(1)
    assert column(features.add_num_services(offline), "num_services") == [0]
    coded = encoding.apply_encoders(encoding.encode_binary(offline), encoding.fit_encoders(accounts))
    # "No phone service" and six times "No internet service" have code 1.
    assert column(features.add_total_services(coded), "TotalServices") == [7]


def test_encoder_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("Z",)], "c string")
    codes = {r["value"]: r["code"] for r in encoding.fit_encoders(df, ["c"]).collect()}
    assert codes == {"Z": 0, "a": 1, "b": 2, "nan": 3}


def test_unseen_category(spark, accounts):
    codes = encoding.fit_encoders(accounts, ["Contract"])
    weekly = spark.createDataFrame([("Weekly",), ("Two year",)], "Contract string")
    assert column(encoding.apply_encoders_lenient(weekly, codes), "Contract") == [0, 2]
    with pytest.raises(Exception, match="unseen value in Contract"):
        encoding.apply_encoders(weekly, codes).collect()


def test_large_vocabulary_is_joined(spark):
    df = spark.range(500).selectExpr("id", "concat('v', lpad(string(id), 4, '0')) AS c")
    coded = encoding.apply_encoders(df, encoding.fit_encoders(df, ["c"]))
    assert coded.where("c <> id").count() == 0
    other = spark.createDataFrame([(1, "zzz")], "id bigint, c string")
    codes = encoding.fit_encoders(df, ["c"])
    assert column(encoding.apply_encoders_lenient(other, codes), "c") == [0]
    with pytest.raises(Exception, match="unseen value"):
        encoding.apply_encoders(other, codes).collect()


def test_label_forms(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("?",), (None,)], "Churn string")
    assert column(encoding.encode_label(df), "Churn") == [1, 0, 0, 0]
    assert column(encoding.encode_label_strict(df), "Churn") == [1, 0, None, None]


def test_binary_encoding_leaves_numbers_alone(spark):
    df = spark.createDataFrame([(1, "Yes"), (0, "maybe")], "SeniorCitizen int, Partner string")
    coded = encoding.encode_binary(df)
    assert column(coded, "SeniorCitizen") == [1, 0] and column(coded, "Partner") == [1, 0]
    assert column(encoding.encode_binary(df, strict=True), "Partner") == [1, None]


def test_default_total_charges(spark):
    df = spark.createDataFrame([(0, 50.0, None), (3, 50.0, None), (3, 50.0, 7.0)],
                               "tenure int, MonthlyCharges double, TotalCharges double")
    assert column(features.default_total_charges(df), "TotalCharges") == [0.0, 150.0, 7.0]
    assert column(features.default_total_charges(df, 1), "TotalCharges") == [50.0, 150.0, 7.0]
    assert column(features.default_total_charges(df.drop("TotalCharges")), "TotalCharges") == [0.0, 150.0, 150.0]


def test_constant_column_is_scaled_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = scaling.scale_all(df, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_feature_counts(accounts):
    assert len(schema.LIBRARY_FEATURES) == 22 and len(schema.NOTEBOOK_FEATURES) == 24
    library = features.features_library(cleaning.clean(accounts))
    notebook = features.features_notebook(cleaning.impute_constant(cleaning.coerce_numeric(accounts)))
    assert set(schema.LIBRARY_FEATURES) <= set(library.columns)
    assert set(schema.NOTEBOOK_FEATURES) <= set(notebook.columns)
    assert profiling.remaining_text_columns(cleaning.drop_identifier(library)).count() == 0


def test_assemble_fills_absent_features(spark):
    df = spark.createDataFrame([(2.0,)], "a double")
    assert features.assemble(df, ["a", "zz"]).first()["features"].toArray().tolist() == [2.0, 0.0]


def test_csv_keeps_blank_charges(spark, accounts, tmp_path):
    path = str(tmp_path / "accounts.csv")
    write_accounts_csv(accounts, path)
    back = read_accounts(spark, path)
    assert back.columns == schema.ACCOUNT_COLUMNS
    assert back.where("TotalCharges = ' '").count() == accounts.where("TotalCharges = ' '").count() > 0


def test_empty_segment_has_null_rate(accounts):
    nobody = accounts.where("SeniorCitizen = 0")
    rows = {r["segment"]: r for r in segments.risk_segments(nobody).collect()}
    assert rows["+ senior"]["n_clients"] == 0 and rows["+ senior"]["churn_rate"] is None


def test_group_without_churner_is_absent(spark):
    df = spark.createDataFrame([("a", "Yes"), ("a", "No"), ("b", "No")], "g string, Churn string")
    assert [tuple(r) for r in segments.rate_by_group(df, "g").collect()] == [("a", 1, 2, 0.5)]


def test_filter_with_empty_list_selects_nothing(accounts):
    assert segments.filter_in(accounts, {"Contract": []}).count() == 0
    assert segments.is_empty(segments.filter_in(accounts, {"Contract": []})).first()[0] is True
    assert segments.is_empty(accounts).first()[0] is False
