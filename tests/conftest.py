import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # A test points spark.checkpoint.dir elsewhere, which a running session refuses otherwise.
        .config("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def accounts(spark):
    from checks.queries import accounts as derive

    return derive(spark, FOLDER).cache()


@pytest.fixture(scope="session")
def scores(spark):
    from checks.queries import scores as derive

    return derive(spark, FOLDER).cache()
