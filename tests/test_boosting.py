import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import queries
from checks.queries import accounts as derive
from ebbline.plans import boosting, models, tuning


@pytest.fixture(scope="module")
def rows(spark):
    """A number of many values, some of few, a constant, and a label that follows two of them."""

    def draw(i, n):
        return F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).cast("double")

    given = spark.range(700).select("id", (draw(1, 10**6) / 7).alias("a"), draw(2, 3).alias("b"), draw(3, 2).alias("c"), F.lit(4.0).alias("d"))
    risk = (F.col("a") > 60000).cast("int") + F.col("b") + draw(4, 3)
    given = given.select("*", (risk > 2).cast("int").alias("label"), (1 + draw(5, 5) / 3).alias("weight"))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(given).cache()


def scores(model, rows):
    return dict(model.transform(rows).select("id", vector_to_array("probability")[1]).collect())


def fit(kind, rows, **changes):
    return models.gbt("b", kind, **{"maxIter": 5, "maxDepth": 3, **changes}).fit(rows)


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"maxBins": 8, "minInstancesPerNode": 40},
        {"maxDepth": 5, "minInfoGain": 0.02, "stepSize": 0.3},
        {"minWeightFractionPerNode": 0.1},
        {"maxDepth": 0},
    ],
)
def test_blocks_grow_the_trees_of_spark(rows, changes):
    theirs, own = (fit(kind, rows, **changes) for kind in (GBTClassifier, boosting.BlockGBT))
    assert type(own) is type(theirs) and own.treeWeights == theirs.treeWeights
    assert scores(own, rows) == pytest.approx(scores(theirs, rows), abs=1e-9)
    assert list(own.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()), abs=1e-9)
    roots = [[t._call_java("rootNode").prediction() for t in m.trees] for m in (own, theirs)]
    assert roots[0] == pytest.approx(roots[1], abs=1e-9)


def test_rows_without_anything_to_split_by(rows):
    same = rows.withColumn("features", VectorAssembler(inputCols=["d"], outputCol="v").transform(rows)["d"]).drop("features")
    same = VectorAssembler(inputCols=["d"], outputCol="features").transform(same)
    theirs, own = (fit(kind, same) for kind in (GBTClassifier, boosting.BlockGBT))
    assert own.totalNumNodes == theirs.totalNumNodes == 5
    assert scores(own, same) == pytest.approx(scores(theirs, same), abs=1e-9)


def test_drawn_rows_and_columns(rows):
    drawn = {"subsamplingRate": 0.5, "featureSubsetStrategy": "0.5"}
    one, two, other = (fit(boosting.BlockGBT, r, **drawn, seed=s) for r, s in ((rows, 1), (rows.orderBy("a"), 1), (rows, 2)))
    # The same rows in another order draw the same; another seed doesn't.
    assert scores(one, rows) == pytest.approx(scores(two, rows), abs=1e-9)
    assert scores(one, rows) != pytest.approx(scores(other, rows), abs=1e-3)
    # Some half of the rows at each root, and the best of two columns, not of all.
    nodes = [t._call_java("rootNode") for t in one.trees]
    sizes = [n.impurityStats().rawCount() for n in nodes]
    assert all(250 < s < 450 for s in sizes) and len(set(sizes)) > 1
    assert len({n.split().featureIndex() for n in nodes}) > 1


def test_a_fit_is_saved_cut_and_loaded(rows, tmp_path):
    own = fit(boosting.BlockGBT, rows)
    own.save(str(tmp_path / "model"))
    assert scores(type(own).load(str(tmp_path / "model")), rows) == scores(own, rows)
    short = fit(boosting.BlockGBT, rows, maxIter=3)
    assert scores(models.first_rounds(own, 3), rows) == pytest.approx(scores(short, rows), abs=1e-12)


def test_wrong_labels_and_no_rows_are_errors(rows):
    for wrong in (rows.withColumn("label", F.lit(2)), rows.limit(0), rows.withColumn("weight", F.lit(-1.0))):
        for kind in (GBTClassifier, boosting.BlockGBT):
            with pytest.raises(Exception):
                fit(kind, wrong)


@pytest.mark.parametrize("at_once", [64, 1])
def test_several_blocks_give_the_trees_of_one(rows, monkeypatch, at_once):
    drawn = {"subsamplingRate": 0.5, "featureSubsetStrategy": "0.5"}
    law, context = {"maxDepth": 4, "maxIter": 7}, rows.sparkSession.sparkContext
    whole = fit(boosting.BlockGBT, rows, **law)
    kept = set(context._jsc.getPersistentRDDs())
    for name, value in {"ALONE_ROWS": 100, "BLOCK_ROWS": 150, "BATCH": 64, "REPLAYED": 3, "BLOCKS_AT_ONCE": at_once}.items():
        monkeypatch.setattr(boosting, name, value)
    parts = fit(boosting.BlockGBT, rows, **law)
    assert scores(parts, rows) == pytest.approx(scores(whole, rows), abs=1e-9)
    assert list(parts.featureImportances.toArray()) == pytest.approx(list(whole.featureImportances.toArray()), abs=1e-9)
    one, two = (fit(boosting.BlockGBT, rows, **law, **drawn) for _ in range(2))
    assert scores(one, rows) == pytest.approx(scores(two, rows), abs=1e-9)
    # Nothing stays cached.
    assert set(context._jsc.getPersistentRDDs()) <= kept


def test_codes_give_back_their_bins():
    packing = boosting.Packing([[1.0] * (n - 1) for n in (32, 2, 1, 3, 300, 40)])
    assert all(np.prod([packing.bins[i] for i in g]) == s for g, s in zip(packing.groups, packing.sizes, strict=True))
    rng = np.random.default_rng(1)
    bins = [rng.integers(0, n, 500) for n in packing.bins]
    codes = np.zeros((len(packing.groups), 500), int)
    for i, own in enumerate(bins):
        codes[packing.group[i]] += own * packing.stride[i]
    counted = packing.by_bin([np.bincount(c, minlength=s) for c, s in zip(codes, packing.sizes, strict=True)])
    for i, own in enumerate(bins):
        assert (packing.bin_of(i)[codes[packing.group[i]]] == own).all()
        assert (counted[packing.starts[i] : packing.starts[i + 1]] == np.bincount(own, minlength=packing.bins[i])).all()


def test_folds_are_boosted_in_few_jobs(spark):
    train = derive(spark, "/root/testdata/sf0.001")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("boosted in few jobs", "")
    try:
        model = queries.FOLD_FITS["gbt_a"](train)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 200 and model.stages[-1].getOrDefault("maxDepth") == 5
    # Spark's own fit has some jobs a level.
    assert len(tracker.getJobIdsForGroup("boosted in few jobs")) < 200


def test_searches_fit_in_few_jobs(spark, monkeypatch):
    train, context = derive(spark, "/root/testdata/sf0.001"), spark.sparkContext
    options = {"grid": {"maxDepth": [2], "maxIter": [20, 60]}, "k": 2}
    context.setJobGroup("searched in few jobs", "")
    try:
        trials, model, best = tuning.grid_search(train, **options)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # Spark's own fit has some jobs a level: three fits of 60 rounds had more than 360.
    assert len(context.statusTracker().getJobIdsForGroup("searched in few jobs")) < 250
    for name, value in {"REFIT_ROWS": 40, "BLOCK_ROWS": 50}.items():
        monkeypatch.setattr(tuning if name == "REFIT_ROWS" else boosting, name, value)
    again, dealt, point = tuning.grid_search(train, **options)
    assert point == best and again.drop("study").exceptAll(trials.drop("study")).count() == 0
    one, two = (dict(models.score(train, m, "m").select("id", "score").collect()) for m in (model, dealt))
    assert two == pytest.approx(one, abs=1e-9)
