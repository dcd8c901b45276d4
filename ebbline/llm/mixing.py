"""Mixing sources to target weights: repetition rates from token counts, then seeded copies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.operators.ordered import global_positions
from ebbline.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
HELPERS = ("size", "source_size", "target", "copies")
# The hash gives 52 bits, all of which a double holds.
_HASH_DIGITS = 13


def free_prefix(columns: list[str]) -> str:
    """``mix_``, with underscores in front until no column is named like a helper."""
    prefix, known = "mix_", {c.lower() for c in columns}
    while any(prefix + name in known for name in (*HELPERS, "source", "copy")):
        prefix = "_" + prefix
    return prefix


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``source``, ``source_size``, ``target`` from a staged table of ``source``, ``source_size``.

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``percent``
    of all sizes; no target exceeds ``most`` times its source, and the excess is shared again by
    weight until none does. Each round is one aggregate over the sources: those at their limit
    leave, the rest share what is left, until no more leave.
    """
    order = [F.col("source").asc_nulls_last()]
    placed = global_positions(sizes, order)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = stage(placed.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * most
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    target = F.lit(0.0)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        row = placed.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(full.cast("int")).alias("capped"),
        ).first()
        if not row["weights"]:
            target = limit.cast("double")
            break
        rest = total * percent / 100 - row["given"]
        level = rest / row["weights"]
        target = F.when(full, limit.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(row["weights"])))
        if row["capped"] == capped:
            break
        capped = row["capped"]
    return placed.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    percent: int = 150,
    most: int = 2,
    seed: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """All columns of ``docs`` and ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies``.

    A source's rate is its target over its size. A document is taken floor(rate) times, and once
    more if its hash, seeded and read as a fraction, lies below the rate's fraction: the same
    documents on every run and under every layout. A null text has size 0; a null source is a
    source of its own; rows that repeat an id share their decision; a source without words has
    rate 0. ``copies`` makes the rows. An empty table gives an empty result. If ``docs`` has a
    column of one of the four names, all four get underscores in front until they are free; they
    are the last four columns in any case.
    """
    prefix = free_prefix(docs.columns)
    size, source_size, target, taken, source = (prefix + n for n in (*HELPERS, "source"))
    sized = docs.withColumn(size, word_count(F.col(text_column).cast("string")))
    sizes = sized.groupBy(F.col(source_column).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = source_targets(stage(sizes, "sizes"), weights, percent, most)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    digits = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    drawn = F.conv(F.substring(digits, 1, _HASH_DIGITS), 16, 10).cast("double") / float(1 << (4 * _HASH_DIGITS))
    named = targets.select(
        F.col("source").alias(source),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
    )
    # The sources' table is small beside the documents; the planner decides how to join it.
    joined = sized.join(named, F.col(source_column).eqNullSafe(F.col(source))).drop(source)
    once_more = (drawn < rate - F.floor(rate)).cast("int")
    return joined.withColumn(taken, (F.floor(rate) + once_more).cast("int"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as it is taken, without the four helper columns."""
    kept, taken = mixed.columns[:-4], mixed.columns[-1]
    number = free_prefix(kept) + "copy"
    repeated = mixed.where(F.col(taken) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(taken))))
    return repeated.select(kept)
