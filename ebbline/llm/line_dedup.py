"""Lines that many documents share, kept in one of them only; built-in functions alone.

Lines are exploded to hashes of their normalised form, hashes counted over distinct documents,
and each document's lines rebuilt in place without those it loses. What is shuffled are hashes
(two 64-bit ones per line and document), combined before the shuffle, never lines.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.sources.staging import stage

# White space stripped from a line's ends.
STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(STRIPPED)), _UPPER, _LOWER)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def drop_shared_lines(
    docs: DataFrame,
    min_length: int = 20,
    min_documents: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``text`` without its shared lines, ``n_lines``, ``n_dropped``, per row.

    A key of at least ``min_length`` code points in at least ``min_documents`` documents loses
    all its lines except in the document with the largest id. Documents are counted by id, so
    repeated rows of one id count once and lose the same lines. A null or empty text is one
    empty line; a row with a null id is not counted and loses nothing. Other columns are not
    looked at; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def long_key(line: Column) -> Column:
        return F.when(F.length(line_key(line)) >= min_length, _hash(line_key(line)))

    keys = F.array_distinct(F.filter(F.transform(_lines("text"), long_key), lambda k: k.isNotNull()))
    held = plain.where("doc_id is not null").select("doc_id", F.explode(keys).alias("key"))
    # Hashes only, read twice; one row per document and key, also where an id has several rows.
    held = stage(held.distinct(), "lines")
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
    shared = shared.where(F.col("documents") >= min_documents).select("key", "keeper")
    lost = held.join(shared, "key").where("doc_id <> keeper")
    lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    both = plain.join(lost, "doc_id", "left")
    kept = F.filter(_lines("text"), lambda line: ~F.coalesce(F.array_contains("lost", _hash(line_key(line))), F.lit(False)))
    both = both.withColumns(
        {
            "n_lines": F.size(_lines("text")).cast("bigint"),
            "kept": F.when(F.col("lost").isNull(), _lines("text")).otherwise(kept),
        }
    )
    return both.select(
        "doc_id",
        F.array_join("kept", "\n").alias("text"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
    )
