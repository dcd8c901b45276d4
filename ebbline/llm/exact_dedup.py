"""Exact duplicates by two passes over a Bloom filter; only rows that may repeat are shuffled.

The first pass marks, for every text's hash, two cells of a filter: once where a cell was met,
again where it was met by another row. The second pass tests each hash against the cells met
twice. A hash with both cells met twice may repeat, and only such rows meet their equals in a
shuffle; all others pass straight through. The filter has 16 cells a row, so its false alarms are
some 1.4 % of the rows that don't repeat at any size; they cost a place in the shuffle and no more.

The filter is cut into segments, merged where they are dealt. Hashes are taken in slices of at
most ``SLICE_ROWS`` expected rows, one filter each, so what is broadcast stays below 2 bytes times
that. Digests are written sorted by hash, hence a slice reads little more than its own pages.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.sharing import opened, share
from ebbline.llm.skew import join_by_heat
from ebbline.sources.staging import stage

# White space that doesn't count.
SPACES = " \t\n\x0b\x0c\r"
CELLS_PER_ROW = 16
SEGMENT_BITS = 18
SLICE_ROWS = 1 << 25
# Hashes that a task sorts at once.
BATCH_ROWS = 1 << 20


def normal_form(text: Column) -> Column:
    """A text without its ASCII white space; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def cells_of(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two different cells of each hash (signed 64-bit)."""
    bits = hashes.view(np.uint64)
    mask = np.uint64((1 << SEGMENT_BITS) - 1)
    first = (bits & mask).astype(np.int64)
    second = ((bits >> np.uint64(SEGMENT_BITS)) & mask).astype(np.int64)
    second ^= first == second
    return ((bits >> np.uint64(2 * SEGMENT_BITS)) % np.uint64(segments)).astype(np.int64), first, second


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def repeated_cells(hashes: DataFrame, segments: int) -> DataFrame:
    """``segment``, ``cells``: bits of the cells that several rows of column ``h`` share."""

    def marks(batches):
        def packed(held):
            segment, first, second = cells_of(np.concatenate(held), segments)
            place = np.concatenate([segment << SEGMENT_BITS | first, segment << SEGMENT_BITS | second])
            place, met = np.unique(place, return_counts=True)
            code = ((place & ((1 << SEGMENT_BITS) - 1)) << 1 | (met > 1)).astype("<u4")
            segment = place >> SEGMENT_BITS
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            codes = [x.tobytes() for x in np.split(code, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(segment[starts], pa.int64()), pa.array(codes, pa.binary())], ["segment", "marks"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_column(batch, "h"))
                n += batch.num_rows
            if n >= BATCH_ROWS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def merged(batches):
        current, once, twice = None, None, None

        def done():
            bits = [np.packbits(twice).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array(bits, pa.binary())], ["segment", "cells"])

        for batch in batches:
            for segment, marks in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != current:
                    if current is not None:
                        yield done()
                    current = segment
                    once, twice = np.zeros((2, 1 << SEGMENT_BITS), bool)
                code = np.frombuffer(marks.as_buffer(), "<u4")
                cell = code >> 1
                twice[cell] |= once[cell] | (code & 1).astype(bool)
                once[cell] = True
        if current is not None:
            yield done()

    dealt = hashes.select("h").mapInArrow(marks, "segment bigint, marks binary").repartition("segment")
    return dealt.sortWithinPartitions("segment").mapInArrow(merged, "segment bigint, cells binary")


def _with_maybe(rows: DataFrame, n: int) -> DataFrame:
    """Staged ``rows`` with ``maybe``: whether the hash ``h`` may be that of another row too."""
    segments = max(1, math.ceil(CELLS_PER_ROW * n / (1 << SEGMENT_BITS)))
    found = stage(repeated_cells(rows, segments), "filter").toArrow()
    size = 1 << (SEGMENT_BITS - 3)
    planes = np.zeros((segments, size), np.uint8)
    for segment, cells in zip(found.column("segment").to_pylist(), found.column("cells")):
        planes[segment] = np.frombuffer(cells.as_buffer(), np.uint8)
    del found
    shared = share(rows.sparkSession, planes)
    del planes

    def probe(batches):
        planes = opened(shared)
        for batch in batches:
            segment, first, second = cells_of(_column(batch, "h"), segments)
            hit = [planes[segment, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 for c in (first, second)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((hit[0] & hit[1]).astype(bool))], [*batch.schema.names, "maybe"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    flagged = stage(rows.mapInArrow(probe, f"{schema}, maybe boolean"), "flagged")
    shared.destroy()
    return flagged


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, per row of ``docs``.

    Texts are equal when they are identical without ASCII white space; a null text counts as
    empty, and all empty texts are equal. Of equal texts the row with the most code points in the
    original text stays, then the smallest id (null last); of rows that tie in both, any one.
    Repeated rows are rows of their own, all with the same ``keep_id``. Other columns aren't
    looked at, whatever their names. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.sha2(normal_form(F.col(text_column)).cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows.withColumn("h", F.xxhash64("text_sha256")).sortWithinPartitions("h"), "digests")
    n = rows.count()
    slices = max(1, math.ceil(n / slice_rows))
    flagged = None
    for i in range(slices):
        low, high = (-(1 << 63) + (1 << 64) * x // slices for x in (i, i + 1))
        part = rows if slices == 1 else rows.where((F.col("h") >= low) & (F.col("h") <= high - 1))
        part = _with_maybe(part, math.ceil(n / slices))
        flagged = part if flagged is None else flagged.unionByName(part)

    maybe = flagged.where("maybe")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    groups = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    groups = stage(groups.withColumn("size", F.col("group_size")), "groups")
    joined = join_by_heat(maybe, groups, ["text_sha256"], "size")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    repeated = joined.withColumn("kept", F.col("row") == F.col("keep_row")).select(columns)
    alone = flagged.where("not maybe").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
    )
    return alone.select(columns).unionByName(repeated)
