"""Joins of per-key statistics to rows whose keys may be very unequal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than one in this many of all rows is hot, so there are fewer hot keys than this.
MOST_HOT = 50_000


def join_by_heat(rows: DataFrame, stats: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the staged ``stats`` (one row per key) but for ``size``.

    ``size`` is the number of rows each key has. The hot keys' statistics are broadcast (at most
    ``MOST_HOT`` rows, whatever the input) and their rows stay where they are; all other rows are
    shuffled on the key, of which none holds more than its small share. ``how`` is inner or left.
    """
    least = (stats.agg(F.sum(size)).first()[0] or 0) // MOST_HOT
    hot = F.broadcast(stats.where(F.col(size) > least).drop(size))
    if not least:
        return rows.join(hot, keys, how)
    rest = rows.join(F.broadcast(stats.where(F.col(size) > least).select(*keys)), keys, "left_anti")
    rest = rest.join(stats.where(F.col(size) <= least).drop(size), keys, how)
    return rows.join(hot, keys).unionByName(rest)
