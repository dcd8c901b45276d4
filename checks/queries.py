"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame.

Doubles are rounded to 6 places here, not in the operators, so that engines which add in
another order agree. The rounding is plain arithmetic, as decimal rounding is not the same
in every engine.
"""

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import accounts_from_orders, scorecard_scores
from ebbline import schema
from ebbline.functions.expressions import risk_level
from ebbline.operators import (
    cleaning,
    curves,
    decisions,
    distributions,
    encoding,
    features,
    importance,
    metrics,
    profiling,
    scaling,
    segments,
    splits,
)
from ebbline.plans import folds, models, preparation, tuning
from ebbline.plans.boosting import BlockGBT
from ebbline.plans.code_tables import CodeTable, CodeTableModel
from ebbline.plans.ledger import run_all
from ebbline.sources import accounts as account_source
from ebbline.sources import prepared
from ebbline.sources.staging import new_path, stage
from ebbline.streaming import scoring as stream_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ID, LABEL = schema.ID, schema.LABEL
PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.floor(F.col(c) * 1_000_000 + 0.5) / F.lit(1e6)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder))
    return function


def on_accounts(name: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: rounded(plan(accounts(spark, folder)))


def on_scores(name: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: rounded(plan(scores(spark, folder)))


def on_table(name: str, table_name: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: rounded(plan(table(spark, folder, table_name)))


# Inputs


SCHEMAS = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per path."""
    path = f"{folder}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return accounts_from_orders(
        table(spark, folder, "customer"), table(spark, folder, "orders")
    )


def numeric(df: DataFrame) -> DataFrame:
    return cleaning.coerce_numeric(df)


def labelled(df: DataFrame) -> DataFrame:
    return encoding.encode_label(df)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return scorecard_scores(accounts(spark, folder))


def line_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A scored table the size of lineitem, without signal."""
    lines = table(spark, folder, "lineitem")
    key = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate"))
    )
    score = F.round(F.col("l_discount") * 5 + F.col("l_tax"), 2)
    return lines.select(
        key.alias("id"),
        F.col("l_linestatus").alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"),
        (score >= 0.3).cast("int").alias("prediction"),
    )


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """A search history: one study per order status, one trial per order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("study"),
        F.col("o_orderkey").alias("trial"),
        F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") / 500000.0, 3)).alias("score"),
    )


def importances(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation strength with the label and with a scorecard, as two models' importances."""
    columns = [*schema.NOTEBOOK_FEATURES]
    base = features.features_notebook(cleaning.impute_constant(numeric(accounts(spark, folder))))
    card = F.round(
        (F.when(F.col("is_monthly_contract") == 1, 3).otherwise(0)
         + F.when(F.col("tenure") < 12, 3).otherwise(0)
         + F.col("MonthlyCharges") / 200.0) / 8.0, 2)
    base = base.withColumn("card", card)
    parts = [
        distributions.label_correlation(base, columns, target).select(
            F.lit(model).alias("model"), "feature", F.abs("corr").alias("importance")
        )
        for model, target in (("card_a", "card"), ("observed", LABEL))
    ]
    return parts[0].unionByName(parts[1])


# Sources and sinks


@query
def read_accounts_csv(spark, folder):
    path = new_path(spark, "csv")
    account_source.write_accounts_csv(accounts(spark, folder), path)
    return account_source.read_accounts(spark, path, "csv")


@query
def read_accounts_orc(spark, folder):
    path = new_path(spark, "orc")
    accounts(spark, folder).write.orc(path)
    return account_source.read_accounts(spark, path, "orc")


@query
def prepared_test_rows(spark, folder):
    path = new_path(spark, "prepared")
    prepared.write_prepared(splits.stratified_split(accounts(spark, folder)), path)
    return prepared.read_prepared(spark, path, "test").select(ID, LABEL, "tenure", "split")


@query
def search_results_csv(spark, folder):
    path = new_path(spark, "search")
    prepared.write_search_results(tuning.rank_trials(trials(spark, folder)), path)
    fields = "study string, trial bigint, score double, rank bigint"
    return spark.read.schema(fields).option("header", True).csv(path)


# Profiling and cleaning

on_accounts("table_profile", profiling.table_profile)
on_accounts("table_preview", lambda a: profiling.preview(a, 5, [ID]))
on_accounts("describe_all", lambda a: profiling.describe_all(numeric(a)))
on_table("describe_lineitem", "lineitem", profiling.describe_all)
on_table("describe_events", "events", profiling.describe_all)
on_accounts("missing_report", lambda a: profiling.missing_report(numeric(a)))
on_accounts("label_distribution", profiling.label_distribution)
on_table("label_distribution_lineitem", "lineitem", lambda t: profiling.label_distribution(t, "l_returnflag"))
on_accounts("drop_identifier", cleaning.drop_identifier)
on_accounts("coerce_numeric", lambda a: numeric(a).select(ID, "TotalCharges"))
on_accounts("impute_median", lambda a: cleaning.impute_median(numeric(a)).select(ID, "TotalCharges"))
on_accounts("impute_constant", lambda a: cleaning.impute_constant(numeric(a)).select(ID, "TotalCharges"))
on_accounts(
    "missing_rows",
    lambda a: profiling.missing_rows(
        numeric(a), "TotalCharges", [ID, "tenure", "MonthlyCharges", "TotalCharges", LABEL]
    ),
)
on_accounts("distinct_values", lambda a: profiling.distinct_values(a, schema.CATEGORY_COLUMNS))
on_accounts("remaining_text_columns", lambda a: profiling.remaining_text_columns(encoding.encode_binary(labelled(numeric(a)))))
on_accounts("clean", cleaning.clean)

# Encoding and features

on_accounts("encode_label", lambda a: labelled(a).select(ID, LABEL))
on_accounts("encode_label_strict", lambda a: encoding.encode_label_strict(a).select(ID, LABEL))
on_accounts("encode_binary", lambda a: encoding.encode_binary(a).select(ID, "SeniorCitizen", *schema.BINARY_COLUMNS))
on_accounts("fit_encoders", encoding.fit_encoders)
on_accounts("apply_encoders", lambda a: encoding.apply_encoders(a, encoding.fit_encoders(a)).select(ID, *schema.CATEGORY_COLUMNS))


@query
def apply_encoders_lenient(spark, folder):
    rows = accounts(spark, folder)
    known = rows.where(F.col("Contract") != "Month-to-month")
    codes = encoding.fit_encoders(known, ["Contract", "gender"])
    return encoding.apply_encoders_lenient(rows, codes).select(ID, "Contract", "gender")


@query
def encoder_table_parts(spark, folder):
    return encoding.encoder_table(table(spark, folder, "part"), ["p_type", "p_brand", "p_name"])


@query
def encode_customer_names(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return encoding.apply_encoders(rows, encoding.fit_encoders(rows, ["c_name", "c_mktsegment"]))


@query
def encode_order_codes(spark, folder):
    """As many categories as there are orders, but for the third that has none, through a saved model."""
    key = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))
    rows = table(spark, folder, "orders").select("o_orderkey", key.alias("code"), F.col("o_orderstatus").alias("status"))
    path = new_path(spark, "code-model")
    CodeTable(inputCols=["code", "status"]).fit(rows).write().save(path)
    return CodeTableModel.load(path).transform(rows)


on_accounts("charges_per_month", lambda a: features.add_charges_per_month(cleaning.clean(a)).select(ID, "ChargesPerMonth"))
on_accounts("charges_per_tenure", lambda a: features.add_charges_per_tenure(a).select(ID, "charges_per_tenure"))
on_accounts("tenure_group", lambda a: features.add_tenure_group(a).select(ID, "TenureGroup"))
on_accounts("tenure_group_no_zero", lambda a: features.add_tenure_group(a, include_lowest=False).select(ID, "TenureGroup"))
on_accounts("tenure_group_open", lambda a: features.add_tenure_group(a.withColumn("tenure", F.col("tenure") + 5), open_ended=True).select(ID, "TenureGroup"))
on_accounts("total_services", lambda a: features.add_total_services(encoding.apply_encoders(encoding.encode_binary(a), encoding.fit_encoders(a))).select(ID, "TotalServices"))
on_accounts("num_services", lambda a: features.add_num_services(a).select(ID, "num_services"))
on_accounts("senior_alone", lambda a: features.add_senior_alone(a).select(ID, "senior_alone"))
on_accounts("monthly_contract", lambda a: features.add_monthly_contract(a).select(ID, "is_monthly_contract"))
on_accounts("fiber_no_security", lambda a: features.add_fiber_no_security(a).select(ID, "fiber_no_security"))
on_accounts("default_total_charges", lambda a: features.default_total_charges(numeric(a)).select(ID, "TotalCharges"))
on_accounts("default_total_charges_form", lambda a: features.default_total_charges(numeric(a), floor=1).select(ID, "TotalCharges"))


def _assembled(a):
    names = ["tenure", "MonthlyCharges", "SeniorCitizen", "absent_feature"]
    values = vector_to_array("features")
    return features.assemble(a, names).select(ID, *[values[i].alias(n) for i, n in enumerate(names)])


on_accounts("assemble_features", _assembled)
SCALED = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]


def _split_numbers(a):
    return splits.stratified_split(cleaning.impute_constant(numeric(a))).select(ID, "split", *SCALED)


on_accounts("scale_all", lambda a: scaling.scale_all(cleaning.impute_constant(numeric(a)).select(ID, *SCALED), SCALED))
on_accounts("scale_train_test", lambda a: scaling.scale_train_test(_split_numbers(a), SCALED))
on_accounts("scaling_audit", lambda a: scaling.scaling_audit(scaling.scale_train_test(_split_numbers(a), SCALED).where("split = 'train'"), SCALED))


@query
def apply_stored_scaler(spark, folder):
    rows = cleaning.impute_constant(numeric(accounts(spark, folder))).select(ID, "Contract", *SCALED)
    stats = stage(scaling.fit_scaler(rows.where("Contract = 'Two year'"), SCALED), "scaler")
    return scaling.apply_scaler(rows, stats)


on_accounts("features_library", lambda a: features.features_library(cleaning.clean(a)))
on_accounts("features_notebook", lambda a: features.features_notebook(cleaning.impute_constant(numeric(a))))

# Splits, folds, weights

on_accounts("stratified_split", lambda a: splits.stratified_split(a).select(ID, LABEL, "split"))
on_table(
    "stratified_split_orders",
    "orders",
    lambda t: splits.stratified_split(t, "o_orderstatus", "o_orderkey", 0.3, 7).select("o_orderkey", "split"),
)
on_accounts("split_audit", lambda a: splits.split_audit(splits.stratified_split(labelled(a))))
on_accounts("stratified_folds", lambda a: splits.stratified_folds(a).select(ID, LABEL, "fold"))
on_accounts("stratified_folds_three", lambda a: splits.stratified_folds(a, k=3).select(ID, LABEL, "fold"))
on_accounts("imbalance_ratio", lambda a: splits.imbalance_ratio(labelled(a)))
on_accounts("class_weights_balanced", lambda a: splits.class_weights(labelled(a)).select(ID, LABEL, "weight"))
on_accounts("class_weights_ratio", lambda a: splits.class_weights(labelled(a), mode="ratio").select(ID, LABEL, "weight"))


@query
def prepare_accounts(spark, folder):
    rows = preparation.prepare_accounts(accounts(spark, folder), new_path(spark, "prepare"))
    return rows.select(ID, LABEL, "split", *schema.LIBRARY_FEATURES)


# Segments

on_accounts("kpis", segments.kpis)
on_accounts("rate_by_contract", lambda a: segments.rate_by_group(a, "Contract"))
on_accounts("count_by_internet", lambda a: segments.count_by(a, "InternetService"))
on_accounts("rate_by_gender", lambda a: segments.rate_by_group(a, "gender"))
on_accounts(
    "rate_by_senior",
    lambda a: segments.rate_by_group(
        segments.label_map(a, "SeniorCitizen", {0: "Non-Senior", 1: "Senior"}, "senior_label"), "senior_label"
    ),
)
CROSSED = [*schema.DEMOGRAPHIC_COLUMNS, "PhoneService", "MultipleLines", "InternetService", *schema.INTERNET_ADDONS, *schema.PLAN_COLUMNS]
on_accounts("crosstab_pct", lambda a: segments.crosstab_pct(a, CROSSED))
on_accounts("churner_heatmap", segments.churner_heatmap)
on_accounts(
    "churner_heatmap_other",
    lambda a: segments.churner_heatmap(
        a.withColumn("Contract", F.when(F.col("tenure") % 3 != 0, F.when(F.col("tenure") % 3 == 1, "Weekly").otherwise(F.col("Contract"))))
    ),
)
on_accounts("service_rates", segments.service_rates)
on_accounts("hierarchy_counts", lambda a: segments.hierarchy_counts(a, "PaymentMethod", LABEL))
on_accounts("risk_segments", segments.risk_segments)
CHOSEN = {"Contract": ["Month-to-month", "Two year"], "InternetService": ["DSL"]}
on_accounts("filter_in", lambda a: segments.filter_in(a, CHOSEN))
on_accounts("filter_in_nothing", lambda a: segments.is_empty(segments.filter_in(a, {"Contract": []})))
on_accounts("rate_by_tenure_group", segments.rate_by_tenure_group)
on_accounts("rate_by_num_services", segments.rate_by_num_services)
on_accounts("headline", segments.headline)
on_table("rate_by_linestatus", "lineitem", lambda t: segments.rate_by_group(t, "l_linestatus", "l_returnflag", "R"))
on_table("count_by_returnflag", "lineitem", lambda t: segments.count_by(t, "l_returnflag", "l_linestatus"))
on_table("crosstab_lineitem", "lineitem", lambda t: segments.crosstab_pct(t, ["l_linenumber", "l_discount"], "l_returnflag", ("A", "N", "R")))
on_table("hierarchy_lineitem", "lineitem", lambda t: segments.hierarchy_counts(t, "l_returnflag", "l_linestatus"))
on_table("rate_by_priority", "orders", lambda t: segments.rate_by_group(t, "o_orderpriority", "o_orderstatus", "F"))

# Distributions

on_accounts("plot_sample", distributions.plot_sample)
on_accounts("histogram_charges", lambda a: distributions.histogram(a, "MonthlyCharges", [LABEL]))
on_accounts("histogram_total_charges", lambda a: distributions.histogram(numeric(a), "TotalCharges", [LABEL], 40))
on_accounts("histogram_tenure", lambda a: distributions.histogram(a, "tenure", [LABEL], 25))
on_table("histogram_orders", "orders", lambda t: distributions.histogram(t, "o_totalprice", ["o_orderpriority"]))
on_accounts("box_stats_charges", lambda a: distributions.box_stats(a, "MonthlyCharges", [LABEL]))
on_accounts("box_stats_total_charges", lambda a: distributions.box_stats(numeric(a), "TotalCharges", [LABEL]))
on_table("box_stats_orders", "orders", lambda t: distributions.box_stats(t, "o_totalprice", ["o_orderpriority"]))
on_table("box_stats_lineitem", "lineitem", lambda t: distributions.box_stats(t, "l_extendedprice", ["l_returnflag"]))
on_table("box_outliers_events", "events", lambda t: distributions.box_outliers(t, "value", ["event_type"], ["event_id"]))
on_accounts("box_outliers_charges", lambda a: distributions.box_outliers(a, "MonthlyCharges", ["Contract"], [ID]))
on_accounts("density_charges", lambda a: distributions.density(a, "MonthlyCharges", ["Contract", LABEL]))
on_accounts("density_tenure", lambda a: distributions.density(a, "tenure", [LABEL], grid=50))
on_accounts("corr_matrix", lambda a: distributions.corr_matrix(labelled(numeric(a)), [*schema.NUMERIC_COLUMNS, "SeniorCitizen", LABEL]))


def _flagged(a):
    return features.add_notebook_features(encoding.encode_label_strict(numeric(a)))


FLAGS = ["num_services", "charges_per_tenure", "senior_alone", "is_monthly_contract", "fiber_no_security"]
on_accounts("label_correlation", lambda a: distributions.label_correlation(_flagged(a), FLAGS))

# Decisions

on_scores("score_profiles", lambda s: decisions.score_profiles(s))
on_scores("risk_levels", lambda s: decisions.add_risk_level(s).select("id", "model", "score", "risk_level"))
on_scores("apply_threshold", lambda s: decisions.apply_threshold(s, 0.35).select("id", "model", "prediction"))


def _with_profile(spark, folder):
    keep = ["Contract", "MonthlyCharges", "tenure", "TechSupport", "OnlineSecurity", "PaymentMethod"]
    return scorecard_scores(accounts(spark, folder), keep)


@query
def recommendations(spark, folder):
    advised = decisions.recommendations(_with_profile(spark, folder))
    return advised.select("id", "model", F.array_join("advice", ",").alias("advice"), F.size("advice_text").alias("n_texts"))


@query
def recommendation_mix(spark, folder):
    return decisions.recommendation_mix(_with_profile(spark, folder))


on_table("clean_text_documents", "documents", lambda t: decisions.clean_text(t.select("doc_id", "text"), "text"))
on_table("clean_text_conversations", "conversations", lambda t: decisions.clean_text(t.select("conv_id", "turn", "text"), "text"))


@query
def high_risk_profile(spark, folder):
    rows = scorecard_scores(accounts(spark, folder), ["tenure", "MonthlyCharges"])
    return decisions.high_risk_profile(features.add_charges_per_tenure(rows))


@query
def score_stream(spark, folder):
    arrived, out = new_path(spark, "profiles"), new_path(spark, "decided")
    accounts(spark, folder).write.parquet(arrived)
    stream = stream_scoring.read_profile_stream(spark, arrived)
    keep = stream_scoring.ADVICE_COLUMNS
    plan = lambda s: stream_scoring.decide(scorecard_scores(s, keep))
    stream_scoring.run_stream(stream, plan, out, new_path(spark, "progress")).awaitTermination()
    decided = spark.read.parquet(out)
    return decided.withColumn("advice", F.array_join("advice", ","))


# Evaluation

on_scores("metrics", metrics.metrics)
on_scores("classification_report", metrics.classification_report)
on_scores("confusion_matrix", metrics.confusion_matrix)
on_scores("confusion_pct", metrics.confusion_pct)
on_scores("roc_points", curves.roc_points)
on_scores("roc_points_thin", lambda s: curves.roc_points(s, thin=True))
on_scores("roc_auc", curves.roc_auc)
on_scores("pr_points", curves.pr_points)
on_scores("average_precision", curves.average_precision)
on_scores("cumulative_gain", curves.cumulative_gain)
on_scores("ideal_gain", curves.ideal_gain)
on_scores("threshold_sweep", metrics.threshold_sweep)
on_scores("best_threshold", metrics.best_threshold)
on_scores("compare_models", metrics.compare_models)
on_scores("compare_models_pct", lambda s: metrics.compare_models(s, percent=True))
on_scores("best_per_metric", lambda s: metrics.best_per_metric(metrics.metrics(s)))
on_scores("soft_vote", models.soft_vote)
on_scores(
    "before_after",
    lambda s: metrics.before_after(
        s.where("model = 'card_a'").withColumn("model", F.lit("card")),
        s.where("model = 'card_b'").withColumn("model", F.lit("card")),
    ),
)


@query
def overfit_check(spark, folder):
    split = splits.stratified_split(accounts(spark, folder))
    return metrics.overfit_check(scorecard_scores(split, ["split"]))


def _fold_scores(spark, folder):
    folded = splits.stratified_folds(accounts(spark, folder))
    return metrics.fold_scores(scorecard_scores(folded, ["fold"]))


@query
def cv_fold_scores(spark, folder):
    return _fold_scores(spark, folder)


@query
def cv_summary(spark, folder):
    return metrics.cv_summary(_fold_scores(spark, folder))


@query
def cv_box(spark, folder):
    return metrics.cv_box(_fold_scores(spark, folder))


@query
def metrics_lineitem(spark, folder):
    return metrics.metrics(line_scores(spark, folder))


@query
def classification_report_lineitem(spark, folder):
    return metrics.classification_report(line_scores(spark, folder))


@query
def confusion_lineitem(spark, folder):
    return metrics.confusion_pct(line_scores(spark, folder))


@query
def roc_points_lineitem(spark, folder):
    return curves.roc_points(line_scores(spark, folder))


@query
def roc_points_thin_lineitem(spark, folder):
    return curves.roc_points(line_scores(spark, folder), thin=True)


@query
def pr_points_lineitem(spark, folder):
    return curves.pr_points(line_scores(spark, folder))


@query
def average_precision_lineitem(spark, folder):
    return curves.average_precision(line_scores(spark, folder))


@query
def cumulative_gain_lineitem(spark, folder):
    return curves.cumulative_gain(line_scores(spark, folder))


@query
def threshold_sweep_lineitem(spark, folder):
    return metrics.threshold_sweep(line_scores(spark, folder))


@query
def top_features(spark, folder):
    return importance.top_features(importances(spark, folder), 15)


@query
def combined_importance(spark, folder):
    return importance.combined_importance(importances(spark, folder), 10)


@query
def importance_shares(spark, folder):
    return importance.importance_shares(importances(spark, folder), 10)


# Models at their published parameters, fitted once per session and folder


def _train_test(spark, folder):
    # Derived once and split once, each written: a split reads its rows three times, a fit and its scores theirs.
    split = stage(splits.stratified_split(stage(accounts(spark, folder), "accounts")), "split")
    return split.where("split = 'train'"), split.where("split = 'test'")


FITS = {
    "logistic": models.fit_logistic,
    "forest": models.fit_forest,
    "gbt_a": lambda rows: models.fit_gbt(rows, "a"),
    "gbt_b": lambda rows: models.fit_gbt(rows, "b"),
}
FITTED = {}


def fitted_models(spark, folder, *names, train=None):
    """The fitted pipelines, each saved by the first query that asks for it and loaded by all.

    ``train`` are the training rows, if the query has split them already.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in FITTED:
        FITTED[key] = train or _train_test(spark, folder)[0], new_path(spark, "models"), set()
    train, path, known = FITTED[key]
    names = names or tuple(FITS)
    missing = [(name,) for name in names if name not in known]
    run_all(spark, lambda name: prepared.save_pipeline(FITS[name](train), path, name), missing, 4)
    known.update(names)
    return {name: prepared.load_pipeline(path, name, tuple(FITS)) for name in names}


def _test_scores(spark, folder, name):
    train, test = _train_test(spark, folder)
    return models.score(test, fitted_models(spark, folder, name, train=train)[name], name)


@query
def logistic_scores(spark, folder):
    return _test_scores(spark, folder, "logistic")


@query
def forest_scores(spark, folder):
    return _test_scores(spark, folder, "forest")


@query
def gbt_a_scores(spark, folder):
    return _test_scores(spark, folder, "gbt_a")


@query
def gbt_b_scores(spark, folder):
    return _test_scores(spark, folder, "gbt_b")


@query
def saved_model_scores(spark, folder):
    loaded = fitted_models(spark, folder, "logistic")["logistic"]
    return models.score(accounts(spark, folder), loaded, "logistic")


@query
def saved_model_same(spark, folder):
    """A model and the same after saving it again and loading it: rows, and rows of equal score."""
    loaded, path = fitted_models(spark, folder, "logistic", "gbt_a"), new_path(spark, "models")
    rows, out = stage(accounts(spark, folder), "accounts"), None
    for name, model in loaded.items():
        prepared.save_pipeline(model, path, name)
        again = models.score(rows, prepared.load_pipeline(path, name), name)
        first = models.score(rows, model, name).select("id", F.col("score").alias("first"))
        both = again.join(first, "id").groupBy("model").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score") == F.col("first")).alias("n_same")
        )
        out = both if out is None else out.unionByName(both)
    return out


@query
def score_all_models(spark, folder):
    train, test = _train_test(spark, folder)
    return models.score_all(fitted_models(spark, folder, train=train), test)


def _voted(spark, folder, train, rows):
    scored = models.score_all(fitted_models(spark, folder, train=train), rows)
    return scored.unionByName(models.soft_vote(scored))


@query
def ensemble_metrics(spark, folder):
    return metrics.metrics(_voted(spark, folder, *_train_test(spark, folder)))


@query
def model_report(spark, folder):
    """What must hold of every fitted model and of their vote, whatever the scores are."""
    train, test = _train_test(spark, folder)
    scored = _voted(spark, folder, train, test)
    # On the rows that they were fitted on, models find the signal at any size.
    learnt = curves.roc_auc(_voted(spark, folder, train, train)).select("model", (F.col("roc_auc") > 0.6).alias("learnt"))
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").alias("n_positive"),
        F.count_if(F.col("score").between(0, 1)).alias("n_in_range"),
        F.count_if(F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("n_decided"),
    ).join(learnt, "model")


@query
def fit_and_evaluate(spark, folder):
    train, test = _train_test(spark, folder)
    known = fitted_models(spark, folder, train=train)
    return models.fit_and_evaluate({name: lambda rows, m=m: m for name, m in known.items()}, train, test)


@query
def feature_importance(spark, folder):
    forest = fitted_models(spark, folder, "forest")["forest"]
    return importance.feature_importance(spark, forest, schema.NOTEBOOK_FEATURES, 15, "forest")


@query
def importance_totals(spark, folder):
    """Importances of a tree model are shares: none is negative, and they sum to 1."""
    out = None
    for name, model in fitted_models(spark, folder, "forest", "gbt_a", "gbt_b").items():
        rows = importance.feature_importance(spark, model, schema.NOTEBOOK_FEATURES, len(schema.NOTEBOOK_FEATURES), name)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"), F.min(F.col("importance") >= 0).alias("sound")
    )


@query
def prepare_profiles(spark, folder):
    rows = accounts(spark, folder)
    fitted = models.fit_logistic(rows, chain="library")
    profiles = rows.drop("TotalCharges", LABEL).withColumn(
        "Contract", F.when(F.col("tenure") > 60, "Weekly").otherwise(F.col("Contract"))
    )
    ready = models.prepare_profiles(profiles, fitted)
    return ready.select(ID, *schema.LIBRARY_FEATURES)


@query
def decisions_by_model(spark, folder):
    scored = _test_scores(spark, folder, "logistic")
    return scored.select("id", "score", risk_level(F.col("score")).alias("risk_level"))


# Nothing of the fitted trees is returned: boosted over blocks, at the published parameters as well.
FOLD_FITS = {
    "gbt_a": lambda rows: models.fit_gbt(rows, "a", kind=BlockGBT),
    "gbt_b": lambda rows: models.fit_gbt(rows, "b", kind=BlockGBT),
}


@query
def model_folds(spark, folder):
    """All four models refitted in five folds: a row per model and fold."""
    # The longest fits first, so that none is left to run alone.
    fits = {**dict(reversed(FITS.items())), **FOLD_FITS}
    runs = folds.fold_runs(stage(accounts(spark, folder), "accounts"), fits, 5, parallelism=8)
    counted = runs.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").alias("n_positive"),
        F.count_if(F.col("score").between(0, 1)).alias("n_in_range"),
    )
    scores = metrics.fold_scores(runs).select("model", "fold", F.col("score").between(0, 1).alias("scored"))
    return counted.join(scores, ["model", "fold"])


def _fits_at_once(spark):
    """A fit may be a single task, so there are as many as the session has slots."""
    return max(8, spark.sparkContext.defaultParallelism)


def _trial_report(trials, k):
    """What must hold of a search's trials: each has its folds' scores, their mean and their spread."""
    each = F.array(*[F.col(f"fold_{i}") for i in range(k)])
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / k
    spread = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("score")) * (x - F.col("score"))) / k)
    near = (F.abs(mean - F.col("score")) < 1e-9) & (F.abs(spread - F.col("std")) < 1e-9)
    return trials.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.size(F.filter(each, lambda x: x.between(0, 1)))).alias("n_fold_scores"),
        F.count_if(near).alias("n_sound"),
        F.count_if(F.col("rank") == 1).alias("n_best"),
        F.countDistinct("params").alias("n_points"),
    )


@query
def random_search_small(spark, folder):
    """Five draws of the second preset on three folds (T2, small form), as published."""
    found, _, _ = tuning.random_search(
        stage(accounts(spark, folder), "accounts"), tuning.SPACE_B_SMALL, n_iter=5, k=3, preset="b", parallelism=_fits_at_once(spark)
    )
    return _trial_report(found, 3)


@query
def grid_search(spark, folder):
    """The published grid of eight points on three folds (T4)."""
    found, _, _ = tuning.grid_search(stage(accounts(spark, folder), "accounts"), parallelism=_fits_at_once(spark))
    return _trial_report(found, 3)


@query
def score_stream_model(spark, folder):
    """A stream of CSV files, some records of which are damaged, scored by a fitted model; the same
    in one batch. Damaged records end apart."""
    model = fitted_models(spark, folder, "logistic")["logistic"]
    arrived = new_path(spark, "arrived")
    rows = accounts(spark, folder)
    account_source.write_accounts_csv(rows, arrived)
    broken = rows.where(F.col(ID).cast("bigint") % 20 == 0)
    # No number of months.
    broken = broken.withColumn("tenure", F.concat(F.lit("about "), F.col("tenure").cast("string")))
    broken.write.mode("append").option("header", True).csv(arrived)

    def plan(part):
        return stream_scoring.score_stream(part, model, "logistic")

    out, apart = new_path(spark, "decided"), new_path(spark, "quarantine")
    stream = account_source.read_accounts_checked(spark, arrived, stream=True, files_per_batch=2)
    stream_scoring.run_checked_stream(stream, plan, out, apart, new_path(spark, "progress")).awaitTermination()
    checked = account_source.read_accounts_checked(spark, arrived)
    sides = {
        "sound": (plan(account_source.sound_records(checked)), out),
        "damaged": (account_source.bad_records(checked), apart),
    }
    found = None
    for side, (batch, path) in sides.items():
        streamed = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(path)
        both = batch.withColumn("s", F.lit(0)).unionByName(streamed.withColumn("s", F.lit(1)))
        row = both.groupBy(F.xxhash64(*batch.columns).alias("h")).agg(
            F.count_if(F.col("s") == 0).alias("b"), F.count_if(F.col("s") == 1).alias("t")
        )
        row = row.agg(F.sum("b").alias("n_batch"), F.sum("t").alias("n_stream"), F.sum(F.least("b", "t")).alias("n_same"))
        row = row.select(F.lit(side).alias("side"), "*")
        found = row if found is None else found.unionByName(row)
    return found


@query
def rank_trials(spark, folder):
    return tuning.rank_trials(trials(spark, folder))


@query
def best_so_far(spark, folder):
    return tuning.best_so_far(trials(spark, folder))


@query
def trial_histogram(spark, folder):
    return tuning.trial_histogram(trials(spark, folder))
