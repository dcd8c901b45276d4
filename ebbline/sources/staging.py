"""Tables written once and read many times, in the folder the cluster shares.

A staged table cuts lineage, survives the loss of executors, and tells the planner its real
size, so a join with it is broadcast or shuffled by fact and not by guess.
"""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side handed out as a broadcast, in rows of a staged (hence counted) table.
MAX_BROADCAST_ROWS = 100_000
# Spark's own limit.
MAX_BUCKETS = 100_000
# Ways that rows of hot keys go when the others are shuffled.
SPREAD = 1 << 20


_LOCAL_FOLDERS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        folder = tempfile.mkdtemp(prefix="ebbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FOLDERS[context.applicationId] = folder
    return _LOCAL_FOLDERS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_folder(spark), "ebbline", f"{name}-{uuid.uuid4().hex}")
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_staged(spark: SparkSession) -> int:
    """Delete what this application has staged so far; returns how many paths there were.

    For the end of a session: results that weren't written elsewhere still read these tables.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    removed = 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(at.getFileSystem(conf).delete(at, True))
    return removed


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, name: str = "stage") -> DataFrame:
    """Like ``stage``, in buckets of ``key``: grouped or joined by it, the rows are not shuffled again."""
    spark = df.sparkSession
    table = f"ebbline_{name}_{uuid.uuid4().hex}"
    # As many as there would be partitions of the shuffle.
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    # Spark writes buckets to tables alone; the files stay when the table's name is given up.
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_path(spark, name)).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return staged


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """Join per-key rows of a *staged* table to ``df`` without moving a hot key (inner or left).

    Few keys: the counted side is broadcast and ``df`` is not shuffled. Many keys: those that
    hold a large share of ``df`` are broadcast all the same, as there can be but few of them, and
    the rest is shuffled on the keys; rows that have theirs already go along, spread by what they
    hold. ``df`` is read once. ``size`` names the column of ``stats`` with the rows of each key in
    ``df`` (at least), which is dropped; without it they are counted.
    """
    n = stats.count()
    if n <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(stats.drop(size) if size else stats), keys, how)
    if not size:
        size = "_size"
        counts = stage(df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), "sizes")
        stats = stage(stats.join(counts, keys), "sized")
    least = (stats.agg(F.sum(size)).first()[0] or 0) // MAX_BROADCAST_ROWS
    values = [c for c in stats.columns if c not in (*keys, size)]
    hot = stats.where(F.col(size) > least)
    hot = hot.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("_hot"))
    cold = stats.where(F.col(size) <= least).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.lit(0).cast("bigint").alias("_spread"),
        F.struct(F.lit(1).alias("_"), *values).alias("_cold"),
    )
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.join(F.broadcast(hot), keys, "left")
    done = F.col("_hot").isNotNull()
    spread = F.when(done, 1 + F.pmod(F.xxhash64(*hashed), F.lit(SPREAD))).otherwise(0)
    # A null key meets nothing.
    rows = rows.withColumns({"_spread": spread, **{f"_key_{k}": F.when(~done, F.col(k)) for k in keys}})
    rows = rows.join(cold, ["_spread", *[f"_key_{k}" for k in keys]], "left")
    if how == "inner":
        rows = rows.where("_hot is not null or _cold is not null")
    taken = [F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in values]
    return rows.select(*keys, *[c for c in df.columns if c not in keys], *taken)
