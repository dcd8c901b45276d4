import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from checks import queries
from checks.queries import accounts as derive
from ebbline import schema
from ebbline.operators import curves, importance, metrics, splits
from ebbline.plans import features_stage, folds, ledger, models, preparation, tuning
from ebbline.sources import accounts, prepared, staging
from ebbline.sources.accounts import write_accounts_csv
from ebbline.streaming import scoring
from tests.conftest import FOLDER

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def parts(spark):
    split = splits.stratified_split(derive(spark, LARGE)).cache()
    return split.where("split = 'train'"), split.where("split = 'test'")


@pytest.fixture(scope="module")
def logistic(parts):
    return models.fit_logistic(parts[0], max_iter=100)


def auc(scored):
    return curves.roc_auc(scored).first()["roc_auc"]


def test_logistic_finds_the_signal(parts, logistic):
    scored = models.score(parts[1], logistic, "logistic")
    assert scored.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert auc(scored) > 0.6


@pytest.mark.parametrize(
    "fit",
    [
        lambda t: models.fit_forest(t, trees=30, depth=6),
        lambda t: models.fit_gbt(t, "a", maxIter=10, maxDepth=3),
        lambda t: models.fit_gbt(t, "b", maxIter=10, maxDepth=3),
    ],
    ids=["forest", "gbt_a", "gbt_b"],
)
def test_trees_find_the_signal(spark, parts, fit):
    model = fit(parts[0])
    assert auc(models.score(parts[1], model, "trees")) > 0.6
    top = importance.feature_importance(spark, model, schema.NOTEBOOK_FEATURES, 5)
    assert top.count() == 5 and top.agg(F.max("relative")).first()[0] == 1.0


def test_importance_needs_a_tree_model(spark, logistic):
    with pytest.raises(ValueError, match="no feature importances"):
        importance.feature_importance(spark, logistic, schema.NOTEBOOK_FEATURES)


def test_saved_model_scores_the_same(spark, parts, logistic, tmp_path):
    prepared.save_pipeline(logistic, str(tmp_path), "logistic")
    loaded = prepared.load_pipeline(str(tmp_path), "logistic")
    one = models.score(parts[1], logistic, "m").select("id", "score")
    two = models.score(parts[1], loaded, "m").select("id", "score")
    assert one.exceptAll(two).count() == 0


def test_unknown_model_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="model_type"):
        prepared.load_pipeline(str(tmp_path), "other", ("logistic", "gbt_a"))
    with pytest.raises(FileNotFoundError):
        prepared.load_pipeline(str(tmp_path), "logistic")


def test_profiles_with_gaps_are_scored(spark, parts, logistic):
    profile = parts[1].limit(3).drop("TotalCharges", "Churn", "gender").withColumn("Contract", F.lit("Weekly"))
    scored = models.score(profile, logistic, "logistic")
    assert scored.where("score IS NOT NULL AND label IS NULL").count() == 3


def test_stream_and_batch_agree(spark, parts, logistic, tmp_path):
    arrived = str(tmp_path / "in")
    parts[1].select(schema.ACCOUNT_COLUMNS).repartition(3).write.parquet(arrived)
    stream = scoring.read_profile_stream(spark, arrived, files_per_batch=1)
    out = str(tmp_path / "out")
    run = scoring.run_stream(
        stream, lambda s: scoring.score_stream(s, logistic, "logistic"), out, str(tmp_path / "progress")
    )
    run.awaitTermination()
    batch = scoring.score_stream(spark.read.parquet(arrived), logistic, "logistic")
    written = spark.read.schema(batch.schema).parquet(out)
    assert written.count() == parts[1].count() and written.exceptAll(batch).count() == 0


def test_prepare_from_csv(spark, tmp_path):
    raw = str(tmp_path / "raw")
    write_accounts_csv(derive(spark, LARGE), raw)
    rows = preparation.prepare(spark, raw, str(tmp_path / "prepared"))
    assert rows.count() == 15_000
    train = prepared.read_prepared(spark, str(tmp_path / "prepared" / "rows"), "train")
    means = train.agg(*[F.avg(c) for c in schema.LIBRARY_FEATURES]).first()
    assert max(abs(m) for m in means) < 1e-9


def test_search_refits_the_best(spark, parts, tmp_path):
    trials, model, best = tuning.grid_search(parts[0], {"maxDepth": [1, 3], "maxIter": [4]}, k=2)
    ranked = trials.orderBy("rank").collect()
    assert len(ranked) == 2 and ranked[0]["score"] >= ranked[1]["score"]
    assert f'"maxDepth": {best["maxDepth"]}' in ranked[0]["params"]
    assert auc(models.score(parts[1], model, "tuned")) > 0.55
    prepared.write_search_results(trials, str(tmp_path / "search"))
    assert spark.read.option("header", True).csv(str(tmp_path / "search")).count() == 2


@pytest.mark.parametrize("column", ["tenure", "MonthlyCharges", "TechSupport", "Contract", "SeniorCitizen"])
def test_absent_and_null_columns_score_alike(parts, logistic, column):
    profiles = parts[1].limit(20).drop("TotalCharges")
    empty = profiles.withColumn(column, F.lit(None).cast(profiles.schema[column].dataType))
    one = scoring.score_stream(profiles.drop(column), logistic, "m")
    two = scoring.score_stream(empty, logistic, "m")
    assert one.count() == 20 and one.exceptAll(two).count() == 0
    if column in ("tenure", "MonthlyCharges", "SeniorCitizen"):
        zero = models.score(profiles.withColumn(column, F.lit(0)), logistic, "m").select("id", "score")
        assert models.score(empty, logistic, "m").select("id", "score").exceptAll(zero).count() == 0


def test_refined_search_returns_what_it_fitted(parts):
    best = {"maxIter": 3, "maxBins": 16, "minInfoGain": 0.001}
    grid = {"maxDepth": [2], "minInstancesPerNode": [1, 3]}
    _, model, point = tuning.fine_tune(parts[0], best, 2, grid, preset="b")
    again = models.fit_gbt(parts[0], "b", **point)
    assert best.items() <= point.items()
    assert auc(models.score(parts[1], model, "m")) == auc(models.score(parts[1], again, "m"))


def test_all_models_share_one_scan(spark, parts, logistic, tmp_path):
    forest = models.fit_forest(parts[0], trees=3, depth=3)
    other = models.fit_gbt(parts[0], "b", maxIter=2, maxDepth=2)
    path = str(tmp_path / "rows")
    parts[1].write.parquet(path)
    rows = spark.read.parquet(path)
    fitted = {"logistic": logistic, "forest": forest, "other": other}
    together = models.score_all(fitted, rows, keep=["tenure"])
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    for name, model in fitted.items():
        one = models.score(rows, model, name)
        assert together.where(F.col("model") == name).select(one.columns).exceptAll(one).count() == 0
    assert together.count() == 3 * rows.count()
    assert together.where("model = 'forest'").select("id", "tenure").exceptAll(rows.select(F.col("customerID"), "tenure")).count() == 0


def test_folds_refit_every_model(spark, tmp_path):
    rows = derive(spark, "/root/testdata/sf0.01")
    seen = []

    def fit(train):
        seen.append(train.count())
        return models.fit_logistic(train, max_iter=10)

    path = str(tmp_path / "runs")
    fits = {"one": fit, "two": lambda t: models.fit_forest(t, trees=3, depth=3)}
    runs = folds.fold_runs(rows, fits, k=3, path=path)
    n = rows.count()
    assert sorted(seen) == [n - s for s in sorted((r["count"] for r in runs.where("model = 'one'").groupBy("fold").count().collect()), reverse=True)]
    for name in fits:
        assert runs.where(F.col("model") == name).select("id").exceptAll(rows.select("customerID")).count() == 0
    assert runs.count() == 2 * n
    summary = {r["model"]: r for r in metrics.cv_summary(metrics.fold_scores(runs)).collect()}
    assert set(summary) == set(fits) and all(r["n_folds"] == 3 and r["mean_score"] > 0.5 for r in summary.values())
    assert metrics.cv_box(metrics.fold_scores(runs)).count() == 2
    # What was kept isn't fitted again.
    again = folds.fold_runs(rows, {**fits, "three": fits["two"]}, k=3, path=path)
    assert len(seen) == 3 and again.count() == 3 * n


def test_search_goes_on_after_its_driver_is_lost(spark, parts, tmp_path, monkeypatch):
    rows = derive(spark, "/root/testdata/sf0.01")
    options = {"grid": {"maxDepth": [1, 3], "maxIter": [3]}, "k": 3, "preset": "b"}
    whole, _, best = tuning.grid_search(rows, **options)
    added, add = [], ledger.Ledger.add

    def lost(self, run, part):
        if len(added) == 4:
            raise RuntimeError("the driver is lost")
        added.append(run)
        add(self, run, part)

    monkeypatch.setattr(ledger.Ledger, "add", lost)
    path = str(tmp_path / "trials")
    with pytest.raises(RuntimeError, match="lost"):
        tuning.grid_search(rows, path=path, parallelism=1, **options)
    # A run that was being written.
    (tmp_path / "trials" / "run=half" / "_temporary").mkdir(parents=True)
    monkeypatch.setattr(ledger.Ledger, "add", lambda self, run, part: (added.append(run), add(self, run, part)))
    found, _, point = tuning.grid_search(rows, path=path, **options)
    assert len(added) == len(set(added)) == 6 and point == best
    names = ["trial", "params", "score", "std", "fold_0", "fold_1", "fold_2", "rank"]
    one, two = (t.select(names).orderBy("trial").collect() for t in (whole, found))
    assert [[pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in r] for r in one] == [list(r) for r in two]
    # Other rows aren't taken for the same.
    tuning.grid_search(rows.where("tenure > 5"), path=path, **options)
    assert len(added) == 12


def test_bad_records_are_set_apart(spark, parts, tmp_path):
    rows = derive(spark, "/root/testdata/sf0.001")
    for fmt in ("csv", "json"):
        path = str(tmp_path / fmt)
        rows.write.format(fmt).option("header", True).save(path)
        broken = rows.limit(7).withColumn("tenure", F.lit("many"))
        broken.write.format(fmt).mode("append").option("header", True).save(path)
        checked = accounts.read_accounts_checked(spark, path, fmt)
        assert accounts.sound_records(checked).count() == rows.count()
        assert accounts.sound_records(checked).select("customerID").count() == rows.count()
        assert accounts.bad_records(checked).where("record like '%many%'").count() == 7
    with pytest.raises(ValueError, match="orc"):
        accounts.read_accounts_checked(spark, path, "orc")


def test_long_vocabularies_stay_a_table(spark, parts, tmp_path, monkeypatch):
    rows = derive(spark, "/root/testdata/sf0.01")
    plain = features_stage.AccountFeatures().fit(rows)
    monkeypatch.setattr(features_stage, "CASE_VALUES", 2)
    model = features_stage.AccountFeatures().fit(rows)
    assert plain.codes is None and model.codes.select("column_name").distinct().count() > 1
    strange = rows.withColumn("Contract", F.when(F.col("tenure") % 3 != 0, F.when(F.col("tenure") > 50, "Weekly").otherwise(F.col("Contract"))))
    want = plain.transform(strange).select(schema.ID, *schema.NOTEBOOK_FEATURES)
    assert model.transform(strange).select(want.columns).exceptAll(want).count() == 0
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = features_stage.AccountFeaturesModel.load(str(tmp_path / "model"))
    assert loaded.transform(strange).select(want.columns).exceptAll(want).count() == 0
    # Beyond the bound of a broadcast, with a value that a third of the rows share.
    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 2)
    spread = loaded.transform(strange).select(want.columns)
    assert spread.count() == rows.count() and spread.exceptAll(want).count() == 0


def test_saved_pipeline_with_a_code_table(spark, parts, tmp_path, monkeypatch):
    monkeypatch.setattr(features_stage, "CASE_VALUES", 2)
    model = models.fit_forest(parts[0], trees=3, depth=3)
    prepared.save_pipeline(model, str(tmp_path), "forest")
    loaded = prepared.load_pipeline(str(tmp_path), "forest")
    one, two = (models.score(parts[1], m, "m").select("id", "score") for m in (model, loaded))
    assert one.exceptAll(two).count() == 0 and loaded.stages[0].codes is not None


def test_first_rounds_are_a_shorter_boosting(parts):
    rows, _ = models.training_frame(parts[0].limit(2000), features_stage.AccountFeatures(), "ratio")
    long, short = (models.gbt("a", maxIter=n, maxDepth=2).fit(rows) for n in (6, 4))
    cut = models.first_rounds(long, 4)
    assert [t.toDebugString.split("\n")[1:] for t in cut.trees] == [t.toDebugString.split("\n")[1:] for t in short.trees]
    assert cut.treeWeights == short.treeWeights
    scores = [sorted(r[0][1] for r in m.transform(rows).select("probability").collect()) for m in (cut, short)]
    assert scores[0] == scores[1]


def test_points_that_differ_in_rounds_share_a_fit(parts, monkeypatch):
    fits = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: fits.append(self.getMaxIter()) or fit(self, rows))
    grid = {"maxDepth": [1, 2], "maxIter": [2, 4]}
    trials, model, best = tuning.grid_search(parts[0].limit(2000), grid, k=2)
    assert trials.count() == 4 and model.stages[-1].getNumTrees == best["maxIter"]
    # Two depths on two folds, and the best again on all rows.
    assert sorted(fits[:-1]) == [4] * 4 and fits[-1] == best["maxIter"]


def test_boosting_has_a_folder_to_cut_its_lineage(spark, parts):
    models.training_frame(parts[0].limit(100), features_stage.AccountFeatures())
    assert spark.sparkContext.getCheckpointDir()


def test_queries_fit_only_what_they_score(spark, monkeypatch):
    asked = []
    for name in queries.FITS:
        fit = models.fit_forest if name == "forest" else models.fit_logistic
        small = {"trees": 2, "depth": 2} if name == "forest" else {"max_iter": 2}
        monkeypatch.setitem(queries.FITS, name, lambda rows, n=name, f=fit, s=small: asked.append(n) or f(rows, **s))
    monkeypatch.setattr(queries, "FITTED", {})
    queries.fitted_models(spark, FOLDER, "logistic")
    assert asked == ["logistic"]
    queries.fitted_models(spark, FOLDER, "logistic", "forest")
    assert asked == ["logistic", "forest"]
    assert list(queries.fitted_models(spark, FOLDER)) == list(queries.FITS)
    assert sorted(asked) == sorted(queries.FITS)


def test_queries_derive_and_split_once(spark, monkeypatch, tmp_path):
    folder, derived = str(tmp_path), []
    # One customer comes twice, one has no key.
    keys = [*range(80), 7, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")
    orders = [(k % 60, 1000.0 * k) for k in range(200)]
    spark.createDataFrame(orders, "o_custkey bigint, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    monkeypatch.setattr(queries, "accounts", lambda s, f: derived.append(f) or derive(s, f))
    monkeypatch.setattr(queries, "FITTED", {})
    monkeypatch.setitem(queries.FITS, "logistic", lambda rows: models.fit_logistic(rows, max_iter=2))
    scored = queries.decisions_by_model(spark, folder)
    assert derived == [folder]
    # What is scored was written with its part, and the given tables aren't read again.
    assert not [f for f in scored.inputFiles() if folder in f]
    split = splits.stratified_split(derive(spark, folder)).where("split = 'test'")
    ids = sorted(str(r["id"]) for r in scored.select("id").collect())
    assert ids == sorted(str(r[schema.ID]) for r in split.collect()) and ids
