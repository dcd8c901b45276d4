"""Results of many runs, kept one by one, so that work goes on where a lost driver left it."""

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


class Ledger:
    """Rows written run by run under one folder; a run is there whole or not at all.

    Each run is a folder of its own, so runs may end at the same time in any order, and what a
    lost driver left half written is neither read nor in the way of doing that run again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def rows(self) -> DataFrame:
        """All rows of the runs that ended; no row before the first."""
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        try:
            return reader.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def add(self, run: str, rows: DataFrame) -> None:
        # One file, so that the committer's single rename makes the whole run appear.
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={run}")


def run_all(spark: SparkSession, work: Callable, tasks: Iterable, parallelism: int) -> list:
    """``work(*task)`` for every task, up to ``parallelism`` of them at once."""
    tasks = list(tasks)
    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.starmap(inheritable_thread_target(spark)(work), tasks)
