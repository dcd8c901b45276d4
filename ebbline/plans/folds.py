"""Every model refitted in every fold, on rows staged once."""

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.operators.splits import stratified_folds
from ebbline.plans.ledger import Ledger, run_all
from ebbline.plans.models import SEED, score
from ebbline.sources.staging import new_path, stage

Fit = Callable[[DataFrame], PipelineModel]


def fold_runs(
    df: DataFrame,
    fits: Mapping[str, Fit],
    k: int = 5,
    seed: int = SEED,
    path: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Validation rows scored by the model that didn't see them (V18): a scored table with ``fold``.

    ``fits`` maps a model's name to a function of training rows. Codes, scaling and model are
    learnt anew inside each fold's training part, so nothing of a validation row leaks into its
    own score. Rows with a null label are in no fold. ``path`` keeps the scored rows of each
    model and fold as it ends; called again with the same path, what is there isn't fitted again
    (use another path for other rows, folds or parameters).
    """
    spark = df.sparkSession
    folded = stratified_folds(df, schema.LABEL, schema.ID, k, seed).where("fold is not null")
    # A directory per fold: each part reads its own folds alone.
    folded_path = new_path(spark, "folds")
    folded.repartition("fold").write.partitionBy("fold").parquet(folded_path)
    rows = spark.read.schema(folded.schema).parquet(folded_path)
    kinds = f"id {folded.schema[schema.ID].dataType.simpleString()}, model string, label int, score double, prediction int, fold int"
    ledger = Ledger(spark, path or new_path(spark, "fold-runs"), kinds)
    done = {tuple(r) for r in ledger.rows().select("model", "fold").distinct().collect()}

    def run(name: str, fold: int) -> None:
        model = fits[name](rows.where(F.col("fold") != fold).drop("fold"))
        ledger.add(f"{name}-{fold}", score(rows.where(F.col("fold") == fold), model, name, ["fold"]))

    run_all(spark, run, [(m, i) for m in fits for i in range(k) if (m, i) not in done], parallelism)
    return ledger.rows().where(F.col("model").isin(*fits))
