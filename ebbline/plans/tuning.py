"""Hyper-parameter search over stratified folds, and reports over its trials."""

import json
import math
import random
import statistics
import zlib

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.operators.distributions import histogram
from ebbline.operators.ordered import ranks, running_totals
from ebbline.operators.splits import stratified_folds
from ebbline.plans.boosting import BlockGBT
from ebbline.plans.features_stage import AccountFeatures
from ebbline.plans.ledger import Ledger, run_all
from ebbline.plans.models import SEED, WEIGHT_MODES, first_rounds, gbt, training_frame
from ebbline.sources.staging import new_path

# The searched ranges, as (kind, low, high) or a list of choices. Leaf
# penalties, bagging temperature and random strength have no counterpart in Spark's trees.
# A split penalty there is a loss summed over a node's rows, Spark's least gain a mean per row:
# its ranges (0 to 0.5, wide 0 to 1) are divided by 100.
SPACE_A = {
    "maxIter": ("int", 100, 499),
    "maxDepth": ("int", 3, 9),
    "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("uniform", 0.6, 1.0),
    "featureSubsetStrategy": ("uniform", 0.6, 1.0),
    "minInstancesPerNode": ("int", 1, 9),
    "minInfoGain": ("uniform", 0.0, 0.005),
}
SPACE_B = {
    "maxIter": [200, 300, 500],
    "maxDepth": ("int", 4, 9),
    "stepSize": ("log", 0.01, 0.2),
    "maxBins": [32, 64, 128, 254],
}
SPACE_B_SMALL = {
    "maxDepth": ("int", 4, 7),
    "stepSize": ("uniform", 0.01, 0.21),
    "maxIter": [100, 200],
}
SPACE_WIDE_A = {
    "maxIter": ("int", 100, 600),
    "maxDepth": ("int", 3, 10),
    "stepSize": ("log", 0.005, 0.3),
    "subsamplingRate": ("uniform", 0.5, 1.0),
    "featureSubsetStrategy": ("uniform", 0.5, 1.0),
    "minInstancesPerNode": ("int", 1, 10),
    "minInfoGain": ("uniform", 0.0, 0.01),
}
SPACE_WIDE_B = {
    "maxIter": ("int", 100, 600),
    "maxDepth": ("int", 4, 10),
    "stepSize": ("log", 0.01, 0.3),
    "maxBins": [32, 64, 128, 254],
}
GRID = {"maxDepth": [3, 5], "stepSize": [0.05, 0.1], "maxIter": [100, 200]}


def draw_params(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """``n`` seeded draws from a space."""
    rng = random.Random(seed)

    def draw(rule):
        if isinstance(rule, list):
            return rng.choice(rule)
        kind, low, high = rule
        if kind == "int":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{name: draw(rule) for name, rule in space.items()} for _ in range(n)]


def _value(name: str, value):
    # The share of columns per node is a text parameter in Spark.
    return str(value) if name == "featureSubsetStrategy" else value


# Rows up to which a lone fit isn't worth a job a level.
REFIT_ROWS = 1 << 20

# A row of the ledger: one point fitted on the training part of one fold.
_TRIAL = "study string, trial int, fold int, params string, job string, score double"


def _job(rows: DataFrame, k: int, preset: str, base: dict) -> str:
    """What a kept result depends on besides its point: the rows, the folds, fixed parameters."""
    mark = F.bit_xor(F.xxhash64("label", "weight", "fold", F.col("features").cast("string")))
    n, sign = rows.agg(F.count(F.lit(1)), mark).first()
    return json.dumps([n, sign, k, preset, base], sort_keys=True)


def cross_validate(
    df: DataFrame,
    points: list[dict],
    k: int = 5,
    preset: str = "a",
    base: dict | None = None,
    study: str = "search",
    parallelism: int = 4,
    path: str | None = None,
) -> tuple[DataFrame, PipelineModel, dict]:
    """Score every point on ``k`` stratified folds by AUC, then refit the best on all rows.

    Returns the ranked trials (mean and population std of the fold scores, and each
    ``fold_<i>``), the refitted pipeline and the best point. ``path`` names a ledger: every point
    and fold is written there as it ends, and a search started again, after its driver was lost
    or with more points, fits only what isn't there. Kept results count only for the same rows,
    folds and fixed parameters. Points that differ in their rounds alone share a fit: a shorter
    boosting is the beginning of a longer one.
    """
    spark, base = df.sparkSession, base or {}
    folded = stratified_folds(df, schema.LABEL, schema.ID, k, SEED).where("fold is not null")
    rows, stages = training_frame(folded, AccountFeatures(), WEIGHT_MODES[preset], keep=["fold"])
    ledger = Ledger(spark, path or new_path(spark, "trials"), _TRIAL)
    job = _job(rows, k, preset, base)
    named = [json.dumps(p, sort_keys=True) for p in points]

    def known() -> dict:
        kept = ledger.rows().where(F.col("job") == job).select("params", "fold", "score").collect()
        return {(r["params"], r["fold"]): r["score"] for r in kept}

    # Exact, and not by bins of the scores.
    evaluator = BinaryClassificationEvaluator(labelCol="label", numBins=0)

    estimators = [gbt(preset, BlockGBT, **{name: _value(name, v) for name, v in {**base, **p}.items()}) for p in points]

    def run(trials: list[int], fold: int) -> None:
        # The first has the most rounds.
        model = estimators[trials[0]].fit(rows.where(F.col("fold") != fold))
        part = rows.where(F.col("fold") == fold)
        for trial in trials:
            own = first_rounds(model, estimators[trial].getMaxIter())
            row = (study, trial, fold, named[trial], job, float(evaluator.evaluate(own.transform(part))))
            ledger.add(f"{study}-{trial}-{fold}-{zlib.crc32((job + named[trial]).encode()):08x}", spark.createDataFrame([row], _TRIAL))

    done, shared = known(), {}
    # The longest fits first, so that none is left to run alone.
    for i in sorted(range(len(points)), key=lambda i: -estimators[i].getMaxIter() * estimators[i].getMaxDepth()):
        others = json.dumps({name: v for name, v in points[i].items() if name != "maxIter"}, sort_keys=True)
        for f in range(k):
            if (named[i], f) not in done:
                shared.setdefault((others, f), []).append(i)
    run_all(spark, run, [(trials, f) for (_, f), trials in shared.items()], parallelism)
    done = known()
    results, means = [], []
    for i, p in enumerate(named):
        each = [done[p, f] for f in range(k)]
        means.append(statistics.fmean(each))
        results.append((study, i, p, means[-1], statistics.pstdev(each), *each))
    kinds = "".join(f", fold_{f} double" for f in range(k))
    trials = spark.createDataFrame(results, f"study string, trial int, params string, score double, std double{kinds}")
    best = max(range(len(points)), key=lambda i: (means[i], -i))
    # No other fit runs beside this one.
    estimators[best].alone_rows = REFIT_ROWS
    return rank_trials(trials), PipelineModel([*stages, estimators[best].fit(rows)]), points[best]


def random_search(df, space=None, n_iter=None, k=5, seed=SEED, preset="a", **options):
    """Seeded random draws, cross-validated: 50 of the first preset (T1), 30 of the other."""
    n_iter = n_iter or (50 if preset == "a" else 30)
    points = draw_params(space or (SPACE_A if preset == "a" else SPACE_B), n_iter, seed)
    return cross_validate(df, points, k, preset, **options)


def grid_points(grid: dict) -> list[dict]:
    """Every combination of a grid, built with Spark's own grid builder."""
    estimator = gbt()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return [{param.name: v for param, v in point.items()} for point in builder.build()]


def grid_search(df, grid=None, k=3, preset="a", **options):
    """A fixed grid, cross-validated (T4): every tree sees all rows and columns."""
    base = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", **(options.pop("base", None) or {})}
    return cross_validate(df, grid_points(grid or GRID), k, preset, base=base, **options)


def refine_grid(best: dict | None = None) -> dict:
    """The grid around a best point: depth +-1, rate halved and doubled, leaf size."""
    best = best or {}
    depth, rate = best.get("maxDepth", 6), best.get("stepSize", 0.05)
    return {
        "maxDepth": [max(3, depth - 1), depth, depth + 1],
        "stepSize": [rate * 0.5, rate, rate * 2],
        "minInstancesPerNode": [1, 3, 5],
    }


def fine_tune(df, best=None, k=5, grid=None, preset="a", **options):
    """Cross-validate the refining grid around a point, of which all else is kept.

    The best point returned holds every parameter that was fitted beside the preset's own.
    """
    start = {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"} if preset == "a" else {}
    base = {"maxIter": 300, **start, **(options.pop("base", None) or {}), **(best or {})}
    base = {name: _value(name, v) for name, v in base.items()}
    points = grid_points(grid or refine_grid(best))
    trials, model, point = cross_validate(df, points, k, preset, base=base, **options)
    return trials, model, {**base, **point}


def wide_search(df, space=None, n=100, k=5, preset="a", refine=True, grid=None, **options):
    """Wide random draws, then a grid around the best, which is refitted on all rows (T5)."""
    space = space or (SPACE_WIDE_A if preset == "a" else SPACE_WIDE_B)
    trials, model, best = random_search(df, space, n, k, preset=preset, study="wide", **options)
    if not refine:
        return trials, model, best
    more, refined, point = fine_tune(df, best, k, grid, preset, study="refined", **options)
    both = rank_trials(trials.unionByName(more).drop("rank"), whole=True)
    top = {r["study"]: r["top"] for r in both.groupBy("study").agg(F.max("score").alias("top")).collect()}
    if top["refined"] >= top["wide"]:
        return both, refined, point
    return both, model, best


def rank_trials(trials: DataFrame, whole: bool = False) -> DataFrame:
    """Rank by score within a study or over all, 1 = best, equal scores share a rank.

    A trial without a score has no rank.
    """
    by = [] if whole else ["study"]
    return ranks(trials, by, "score", descending=True)


def best_so_far(trials: DataFrame) -> DataFrame:
    """Best score up to each trial."""
    best = running_totals(trials, ["study"], "trial", ["score"], how="max")
    return best.select(*trials.columns, F.col("run_score").alias("best_score"))


def trial_histogram(trials: DataFrame, bins: int = 20) -> DataFrame:
    """Distribution of trial scores, null scores left out."""
    return histogram(trials, "score", ["study"], bins)
