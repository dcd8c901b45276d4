"""The account features as a Spark ML stage, so that serving repeats training exactly."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.operators.cleaning import coerce_numeric
from ebbline.operators.encoding import CASE_VALUES, encode_binary, fit_encoders, look_up
from ebbline.operators.features import (
    add_library_features,
    add_notebook_features,
    add_tenure_group,
    default_total_charges,
    with_feature_columns,
)
from ebbline.operators.scaling import fit_scaler
from ebbline.plans.code_tables import WithCodes
from ebbline.sources.staging import stage



class _AccountParams(HasInputCols):
    """``inputCols`` is the ordered feature list."""

    chain = Param(
        Params._dummy(), "chain", "feature chain: library or notebook", TypeConverters.toString
    )
    scaled = Param(Params._dummy(), "scaled", "whether to z-score", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(chain="notebook", scaled=False, inputCols=schema.NOTEBOOK_FEATURES)


def with_raw_columns(df: DataFrame) -> DataFrame:
    """Every raw feature column; absent ones are null."""
    kinds = {f.name: f.dataType for f in schema.ACCOUNT_SCHEMA if f.name in schema.RAW_FEATURES}
    absent = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _raw_features(df: DataFrame, chain: str) -> DataFrame:
    """Numeric charges with absent totals defaulted, and the flags that read raw texts."""
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("tenure", "MonthlyCharges")}
    cleaned = default_total_charges(coerce_numeric(with_raw_columns(df).withColumns(numbers)))
    return add_notebook_features(cleaned) if chain == "notebook" else cleaned


def _late_features(df: DataFrame, chain: str) -> DataFrame:
    if chain == "notebook":
        return df
    return add_library_features(df).transform(add_tenure_group, open_ended=True)


class AccountFeatures(Estimator, _AccountParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns category codes and, if asked, scaling from training rows."""

    @keyword_only
    def __init__(self, *, chain="notebook", scaled=False, inputCols=None):
        super().__init__()
        names = schema.NOTEBOOK_FEATURES if chain == "notebook" else schema.LIBRARY_FEATURES
        self._set(chain=chain, scaled=scaled, inputCols=list(inputCols or names))

    def _fit(self, df: DataFrame) -> "AccountFeaturesModel":
        columns = [c for c in schema.CATEGORY_COLUMNS if c in df.columns]
        codes = stage(fit_encoders(df, columns), "codes")
        sizes = {r[0]: r[1] for r in codes.groupBy("column_name").count().collect()}
        # Short vocabularies become parameters, longer ones stay a table.
        vocabulary: dict[str, list[str]] = {c: [] for c in columns if sizes.get(c, 0) <= CASE_VALUES}
        for row in codes.where(F.col("column_name").isin(list(vocabulary))).orderBy("code").collect():
            vocabulary[row["column_name"]].append(row["value"])
        chain, names = self.getOrDefault("chain"), self.getInputCols()
        model = AccountFeaturesModel()
        if len(vocabulary) < len(columns):
            model.codes = codes.where(~F.col("column_name").isin(list(vocabulary)))
        model._set(chain=chain, scaled=False, inputCols=names, vocabulary=vocabulary)
        if self.getOrDefault("scaled"):
            stats = fit_scaler(model.transform(df), names).first()
            moments = {c: [stats[c]["mean"], stats[c]["std"]] for c in names}
            model._set(scaled=True, moments=moments)
        return model


class AccountFeaturesModel(Model, _AccountParams, WithCodes):
    """Raw profiles to encoded, completed and scaled feature columns.

    An unseen category becomes code 0, absent total charges the monthly charge times the
    months, any other absent or null feature 0; tenure buckets are open at both ends.
    """

    vocabulary = Param(Params._dummy(), "vocabulary", "sorted values per category column")
    moments = Param(Params._dummy(), "moments", "mean and std per scaled feature")

    def __init__(self):
        super().__init__()
        self._setDefault(vocabulary={}, moments={})

    def _transform(self, df: DataFrame) -> DataFrame:
        chain, names = self.getOrDefault("chain"), self.getInputCols()
        out = encode_binary(_raw_features(df, chain))
        vocabulary = self.getOrDefault("vocabulary")
        # A column that training lacked has no codes: all 0.
        coded = {c: F.lit(0) for c in schema.CATEGORY_COLUMNS}
        for column, values in vocabulary.items():
            text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
            place = F.array_position(F.array(*[F.lit(v) for v in values]), text)
            coded[column] = F.greatest(place - 1, F.lit(0)).cast("int")
        if self.codes is not None:
            long = [r[0] for r in self.codes.select("column_name").distinct().collect()]
            out = look_up(out, self.codes, long, unseen="zero")
            coded = {c: x for c, x in coded.items() if c not in long}
        out = _late_features(out.withColumns(coded), chain)
        out = with_feature_columns(out, names)
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
        if not self.getOrDefault("scaled"):
            return out
        moments = self.getOrDefault("moments")
        scaled = {c: F.expr(f"(`{c}` - ({moments[c][0]!r}D)) / {moments[c][1]!r}D") for c in names}
        return out.withColumns(scaled)
