"""Category codes as a Spark ML stage; the codes travel beside a saved model as a table."""

from pyspark import keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from ebbline.operators.encoding import fit_encoders, look_up
from ebbline.sources.staging import stage

FOLDER = "codes"


class _Writer(MLWriter):
    def __init__(self, instance: "WithCodes"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        if self.instance.codes is not None:
            self.instance.codes.write.parquet(f"{path}/{FOLDER}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.kind()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        try:
            instance.codes = self.sparkSession.read.parquet(f"{path}/{FOLDER}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return instance


class WithCodes(MLReadable, MLWritable):
    """A model with a code table (``column_name, value, code``), or with none.

    Parameters are saved as text that every reader holds whole; the table is saved as Parquet
    next to them, and stays a table when the model is loaded.
    """

    codes: DataFrame | None = None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class CodeTable(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the codes of text columns of any number of values (F4 as a stage)."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(inputCols=list(inputCols or []))

    def _fit(self, df: DataFrame) -> "CodeTableModel":
        model = CodeTableModel()
        model._set(inputCols=self.getInputCols())
        model.codes = stage(fit_encoders(df, self.getInputCols()), "codes")
        return model


class CodeTableModel(Model, HasInputCols, WithCodes):
    """Replaces categories by their codes, an unseen one by 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = [c for c in self.getInputCols() if c in df.columns]
        return look_up(df, self.codes, columns, unseen="zero").select(*df.columns)
