"""Connected components of a staged table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.sources.staging import stage


def _state(edges: DataFrame):
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return edges.agg(F.count(F.lit(1)), F.sum(mark)).first()


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` for every vertex of the edges ``u``, ``v`` (bigint).

    A component's name is its smallest vertex. Large-star and small-star steps alternate: each
    links the neighbours of a vertex to the smallest among them, so that a hub's edges spread
    out and the number of edges never grows. Each step is a map-side combined minimum and a join
    back on the vertex (a skewed one is split by the planner); each round is written to the
    shared folder. No edges: an empty table.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = stage(ends.where("u <> v").distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        current = stage(small.where("u <> v").union(lowest.select("u", "low")).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
