"""A session with the settings the operators are planned for."""

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, app: str = "ebbline"
) -> SparkSession:
    """Adaptive execution with skew handling, UTC; the cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
