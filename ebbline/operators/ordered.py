"""Running totals, exact quantiles and ranks over a global order, without a global window.

A window over all rows (or over one of two classes) is one task. Here the order is cut into
cells first, sized from the counted rows; only the cell totals, whose number is bounded, are
summed across the whole order, and the rows are summed inside their own cell. Cells that turn out
too large are cut again, at any depth, so tables of every size take the same plan.

A cell is a number that sorts like the values in it. Its remainder by 3 says what it holds: 0 one
value, 1 rows of one value cut by a hash, 2 a range of values.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.sources.staging import attach, stage

# Rows a cell is meant to hold, and how many cells there are at most.
CELL_ROWS = 1 << 14
MOST_CELLS = 1 << 20
# Cells made by one cut.
FAN = 1 << 12
ONE_VALUE, ONE_HASH, RANGE = 0, 1, 2
# Quantile sketches: values kept per level, and groups of input partitions merged first.
SKETCH_SIZE = 2000
MERGE_GROUPS = 256
# Ties are ordered by a 60-bit hash.
TIE_BITS = 60


def tie_hash(text: Column) -> Column:
    """The first 60 bits of the md5 of a text, as a number that sorts like its hex digits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, TIE_BITS // 4), 16, 10).cast("bigint")


def _doubles(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def _passed_edges(rows: DataFrame, most: int) -> DataFrame:
    """``_at``: how many of the sorted ``_edges`` (up to ``most``) are <= ``_key``.

    One projection per halving: all of them compile into the scan's loop.
    """
    rows = rows.withColumn("_at", F.lit(0))
    step = 1 << max(most, 1).bit_length() - 1
    while step:
        passed = f"try_element_at(_edges, _at + {step}) <= _key"
        rows = rows.withColumn("_at", F.expr(f"_at + IF({passed}, {step}, 0)"))
        step >>= 1
    return rows


def _on_edge() -> Column:
    return (F.col("_at") > 0) & (F.element_at("_edges", F.greatest("_at", F.lit(1))) == F.col("_key"))


def _first_cells(rows: DataFrame, cell_rows: int) -> tuple[DataFrame, int]:
    """Rows with ``_cell`` by their ``_key``, and how many rows a cell is meant to hold.

    The edges are estimated quantiles of all groups together, so no cell of any group exceeds its
    share but for the estimate's error; a value that an edge falls on has a cell of its own. The
    sketch is written down, so that all readers see the same edges.
    """
    sketch = _sketch(rows, [], "_key", max(SKETCH_SIZE, 4 * FAN))
    sketch = stage(sketch.select("_s", F.kll_sketch_get_n_double("_s").alias("n")), "sketch")
    counted = sketch.select("n").first()
    n = counted["n"] if counted else 0
    size = max(cell_rows, n // MOST_CELLS)
    cells = min(FAN, max(1, math.ceil(n / size)))
    if cells == 1:
        return rows.withColumn("_cell", F.lit(RANGE).cast("bigint")), size
    ranks = _doubles([i / cells for i in range(1, cells)])
    edges = sketch.select(F.kll_sketch_get_quantile_double("_s", ranks)).scalar()
    rows = _passed_edges(rows.withColumn("_edges", edges), cells - 1)
    cell = 3 * F.col("_at") + F.when(_on_edge(), ONE_VALUE).otherwise(RANGE)
    # Never null: were it nullable, a join on it would push a null check, and with it the search
    # for the cell, down to every raw row.
    return rows.withColumn("_cell", F.coalesce(cell.cast("bigint"), F.lit(RANGE))).drop("_edges", "_at"), size


def _too_large(totals: DataFrame, size: int, tie: str | None) -> DataFrame:
    """Cells of which a group has many more rows than meant, and that can be cut: ``_cell``,
    ``_range`` (whether it is one) and ``_parts`` to cut it into. ``totals`` is staged.

    Written down: the planner would carry a condition on a table's cells over to the rows that it
    is joined to, and search for the cell of every row again for it.
    """
    is_range = F.col("_cell") % 3 == RANGE
    can = is_range | (F.col("_cell") % 3 == ONE_VALUE) if tie else is_range
    large = totals.where((F.col("_n") > 2 * size) & can).groupBy("_cell").agg(F.max("_n").alias("_rows"))
    parts = F.least(F.ceil(F.col("_rows") / size), F.when(is_range, FAN).otherwise(MOST_CELLS))
    return stage(large.select("_cell", is_range.alias("_range"), parts.cast("int").alias("_parts")), "large")


def _cut_again(rows: DataFrame, large: DataFrame, size: int, tie: str | None) -> DataFrame:
    """Rows of the counted cells ``large`` in smaller ones: ranges by their own quantiles, one
    value by the leading part of its rows' ``tie``."""
    ranges = rows.join(F.broadcast(large.where("_range")), "_cell")
    most = large.where("_range").agg(F.max("_parts")).first()[0] or 2
    sketch = F.kll_sketch_agg_double("_key", F.lit(min(max(SKETCH_SIZE, 4 * most), 65535)))
    cuts = ranges.groupBy("_cell", "_parts").agg(sketch.alias("_s"))
    # The function wants fixed ranks: those of the most parts, of which each cell takes its share.
    finest = F.kll_sketch_get_quantile_double("_s", _doubles([i / most for i in range(1, most)]))
    steps = F.sequence(F.lit(1), F.col("_parts") - 1)
    edges = F.transform(steps, lambda i: F.element_at(finest, F.floor(i * most / F.col("_parts")).cast("int")))
    cuts = stage(cuts.select("_cell", edges.alias("_edges")), "edges")
    # Together at most MOST_CELLS parts, like the cells.
    cuts = large.select("_cell", "_parts").join(cuts, "_cell", "left")
    kind = (F.col("_cell") % 3).cast("int")
    placed = _passed_edges(rows.join(F.broadcast(cuts), "_cell", "left"), most)
    within = F.when(F.col("_edges").isNotNull(), 3 * F.col("_at") + F.when(_on_edge(), ONE_VALUE).otherwise(RANGE))
    if tie:
        part = F.floor(F.shiftright(F.col(tie), TIE_BITS - 30) * F.col("_parts") / (1 << 30)).cast("int")
        within = within.when(F.col("_parts").isNotNull() & (kind == ONE_VALUE), 3 * part + ONE_HASH)
    cell = F.col("_cell") * (3 * (MOST_CELLS + 1)) + F.coalesce(within, kind, F.lit(RANGE))
    return placed.withColumn("_cell", cell).drop("_edges", "_at", "_parts")


def _in_cells(
    rows: DataFrame, by: list[str], tie: str | None, totals: dict[str, Column], cell_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_cell``, and the staged totals of each group's cells with their count ``_n``."""
    rows, size = _first_cells(rows, cell_rows)
    while True:
        summed = rows.groupBy(*by, "_cell").agg(
            F.count(F.lit(1)).alias("_n"), *[x.alias(name) for name, x in totals.items()]
        )
        summed = stage(summed, "cells")
        if not (summed.agg(F.max("_n")).first()[0] or 0) > 2 * size:
            return rows, summed
        large = _too_large(summed, size, tie)
        if large.isEmpty():
            return rows, summed
        rows = _cut_again(rows, large, size, tie)


def running_totals(
    df: DataFrame,
    by: list[str],
    order: str,
    measures: list[str],
    descending: bool = False,
    tie: str | None = None,
    tie_break: list[str] | None = None,
    how: str = "sum",
    staged: bool = True,
    following: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add ``run_<m>`` (inclusive running sum) and ``all_<m>`` (group sum) per measure.

    With ``how="max"`` both are maxima. ``following`` names columns without nulls whose value in
    the next row is added as ``next_<c>``, null in a group's last row; a cell's last row takes it
    from the first row of the next cell, which the totals keep. ``order`` is a numeric column, unique inside a ``by``
    group unless ``tie`` names a column of hashes (see ``tie_hash``); equal values are then
    ordered by ``tie`` and ``tie_break``. Rows with a null key or order are left out.

    The input is read three times (edges, cell totals, rows), so an aggregate is staged
    first; pass ``staged=False`` for rows that are cheaper to read again than to write.
    """
    rows = df.dropna(subset=[*by, order])
    key = F.col(order).cast("double")
    ordering = [-key if descending else key, *([tie] if tie else []), *(tie_break or [])]
    fold = {"sum": F.sum, "max": F.max}[how]
    if staged:
        rows = stage(rows, "ordered")
    rows = rows.withColumn("_key", ordering[0])
    following = following or []
    first = F.struct("_key", *ordering[1:])
    kept = {f"_cell_{m}": fold(m) for m in measures} | {f"_first_{c}": F.min_by(c, first) for c in following}
    rows, totals = _in_cells(rows, by, tie, kept, cell_rows)

    place = [*by, "_cell"]
    across = Window.partitionBy(*by, F.lit(0)).orderBy("_cell")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    offsets = totals.select(
        *place,
        *[fold(f"_cell_{m}").over(before).alias(f"_before_{m}") for m in measures],
        *[fold(f"_cell_{m}").over(whole).alias(f"all_{m}") for m in measures],
        *[F.lead(f"_first_{c}").over(across).alias(f"_after_{c}") for c in following],
    )
    inside = Window.partitionBy(*place).orderBy("_key", *ordering[1:])
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns(
        {f"_in_{m}": fold(m).over(up_to) for m in measures}
        | {f"_next_{c}": F.lead(c).over(inside) for c in following}
    )

    def combined(m: str) -> Column:
        if how == "max":
            return F.greatest(f"_before_{m}", f"_in_{m}")
        return F.coalesce(F.col(f"_before_{m}"), F.lit(0)) + F.col(f"_in_{m}")

    return summed.join(offsets, place).select(
        *df.columns,
        *[combined(m).alias(f"run_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
        *[F.coalesce(f"_next_{c}", f"_after_{c}").alias(f"next_{c}") for c in following],
    )


def ranks(
    df: DataFrame,
    by: list[str],
    order: str,
    descending: bool = False,
    name: str = "rank",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``df`` with each row's rank in its group, 1 = first, equal values sharing a rank.

    Equal values are always in the same cell, so a rank is the rows of the cells before plus the
    rank inside the cell. Rows of a cell of one value all have its first place: however many they
    are, they stay where they are. A row with a null key or order has no rank.
    """
    rows = stage(df, "ranked")
    placed = rows.dropna(subset=[*by, order])
    key = F.col(order).cast("double")
    placed, totals = _in_cells(placed.withColumn("_key", -key if descending else key), by, None, {}, cell_rows)
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    single = (F.col("_cell") % 3 == ONE_VALUE).alias("_single")
    skipped = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    # The joins choose the rows, by a column: see ``_too_large``.
    offsets = stage(totals.select(*by, "_cell", skipped, "_n", single), "offsets")
    split = attach(placed, offsets.where("not _single").drop("_single"), [*by, "_cell"], size="_n")
    split = split.withColumn("_in", F.rank().over(Window.partitionBy(*by, "_cell").orderBy("_key")))
    alike = attach(placed, offsets.where("_single").drop("_single"), [*by, "_cell"], size="_n")
    out = [*df.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias(name)]
    found = split.select(out).unionByName(alike.withColumn("_in", F.lit(1)).select(out))
    missing = F.lit(False)
    for c in (*by, order):
        missing = missing | F.col(c).isNull()
    return found.unionByName(rows.where(missing).withColumn(name, F.lit(None).cast("bigint")))


class CellIndex:
    """The values of a column per group, cut into cells whose count, minimum and maximum are kept.

    Questions about the order are answered from the cells; only those cells are read again whose
    inside matters. ``cells`` has ``by``, ``_cell``, ``_n``, ``lo``, ``hi``, ``skip`` (rows of the
    cells before), and the group's ``n``, ``min`` and ``max``.
    """

    def __init__(self, df: DataFrame, by: list[str], value: str, cell_rows: int = CELL_ROWS):
        self.by = by
        values = df.dropna(subset=[*by, value]).select(*by, F.col(value).cast("double").alias("_key"))
        self.rows, self.size = _first_cells(values, cell_rows)
        self.cells = self._summed(self.rows, [])

    def _summed(self, rows: DataFrame, kept: list[str]) -> DataFrame:
        """Totals per cell. With ``kept`` (skip, n, min, max) the rows are those of cut cells."""
        place = [*self.by, *kept, "_cell"]
        totals = rows.groupBy(*place).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")
        )
        group = Window.partitionBy(*self.by, *kept, F.lit(0))
        before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        skip = F.coalesce(F.sum("_n").over(before), F.lit(0))
        whole = {"n": F.sum("_n"), "min": F.min("lo"), "max": F.max("hi")}
        return stage(
            totals.select(
                *self.by,
                "_cell",
                "_n",
                "lo",
                "hi",
                (skip + F.col("skip") if kept else skip).alias("skip"),
                *[F.col(c) if kept else x.over(group).alias(c) for c, x in whole.items()],
            ),
            "cells",
        )

    def values(self, wanted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Distinct values ``_key`` and their counts ``c`` in cells selected from a staged table.

        A cell of one value is known without reading it.
        """
        columns = [*self.by, "_cell", "_key", "c", "skip", "n", "min", "max"]
        known = wanted.where("lo = hi").withColumns({"_key": F.col("lo"), "c": F.col("_n")}).select(columns)
        inside = wanted.where("lo < hi").select(*self.by, "_cell", "_n", "skip", "n", "min", "max")
        rows = self.rows if rows is None else rows
        read = attach(rows.select(*self.by, "_cell", "_key"), inside, [*self.by, "_cell"], size="_n")
        counted = read.groupBy(*self.by, "_cell", "_key", "skip", "n", "min", "max").agg(F.count(F.lit(1)).alias("c"))
        return known.unionByName(counted.select(columns))

    def around(self, ranks: Column) -> DataFrame:
        """Counted values of the cells that hold one of the ranks (0-based, from size ``n``).

        Ranges that are still too large are cut again where they hold a rank, at any depth.
        """
        rows, cells, parts = self.rows, self.cells, []
        while True:
            end = F.col("skip") + F.col("_n")
            held = stage(cells.where(F.exists(ranks, lambda x: (x >= F.col("skip")) & (x < end))), "held")
            large = (F.col("_n") > 2 * self.size) & (F.col("lo") < F.col("hi"))
            parts.append(self.values(held.where(~large), rows))
            if held.where(large).isEmpty():
                break
            kept = ["skip", "n", "min", "max"]
            again = held.where(large).select(*self.by, "_cell", "_n", *kept)
            rows = attach(rows.select(*self.by, "_cell", "_key"), again, [*self.by, "_cell"], size="_n")
            rows = _cut_again(rows, _too_large(held, self.size, None), self.size, None)
            cells = self._summed(rows, kept)
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def quantiles(self, probs: list[float]) -> DataFrame:
        """``by``, ``n``, ``min``, ``max`` and linearly interpolated ``q0 .. qk``, exact."""

        def rank(p: float) -> Column:
            return F.floor(p * (F.col("n") - 1))

        counts = self.around(F.array(*[x for p in probs for x in (rank(p), rank(p) + 1)]))
        inside = Window.partitionBy(*self.by, "_cell", "skip").orderBy("_key")
        inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("past", F.col("skip") + F.sum("c").over(inside))
        first = F.col("past") - F.col("c")

        def holding(x: Column) -> Column:
            return F.max(F.when((first <= x) & (x < F.col("past")), F.col("_key")))

        aggregates = []
        for i, p in enumerate(probs):
            aggregates += [holding(rank(p)).alias(f"_lo{i}"), holding(rank(p) + 1).alias(f"_hi{i}")]
        whole = [F.max("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")]
        picked = counts.groupBy(*self.by).agg(*whole, *aggregates)
        out = []
        for i, p in enumerate(probs):
            part = p * (F.col("n") - 1) - rank(p)
            low, high = F.col(f"_lo{i}"), F.coalesce(f"_hi{i}", f"_lo{i}")
            out.append((low + (high - low) * part).alias(f"q{i}"))
        return picked.select(*self.by, "n", "min", "max", *out)


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any size.

    The rows of each cell are counted without moving them; only the cells that hold a wanted
    rank are then looked into, equal values collapsed. Returns ``by``, ``n``, ``min``,
    ``max`` and ``q0 .. qk`` in the order of ``probs``.
    """
    return CellIndex(df, by, value, cell_rows).quantiles(probs)


def _sketch(df: DataFrame, by: list[str], value: str, size: int) -> DataFrame:
    """One quantile sketch ``_s`` per group, merged in two steps.

    A sketch per input partition meets others of its partition group first, so that no task
    receives the sketches of all input partitions.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
    # The constant key makes an empty table give no sketch, rather than an empty one.
    partial = df.groupBy(*by, F.lit(0).alias("_all"), part.alias("_part")).agg(
        F.kll_sketch_agg_double(value, F.lit(size)).alias("_s")
    )
    merged = partial.groupBy(*by, "_all").agg(F.kll_merge_agg_double("_s", F.lit(size)).alias("_s"))
    return merged.drop("_all")


def approximate_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], size: int = 8000
) -> DataFrame:
    """Same columns from mergeable sketches, without a shuffle of values.

    The rank error is well below one part in a thousand at the default size.
    """
    values = df.dropna(subset=[*by, value]).select(*by, F.col(value).cast("double").alias("_v"))
    sketched = _sketch(values, by, "_v", size)
    exact = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    both = exact.join(sketched, by) if by else exact.withColumn("_s", sketched.scalar())
    picked = both.withColumn("_q", F.kll_sketch_get_quantile_double("_s", _doubles(probs)))
    return picked.select(*by, "n", "min", "max", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def global_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add each row's 0-based place in the order of any sortable columns (unique rows).

    Spark's range-partitioned sort is written once together with the row's place inside its
    partition, so the offsets and the rows always speak of the same layout.
    """
    laid_out = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_at", 33)
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = laid_out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    # One row per partition of the sort, so its number never follows the data.
    placed = laid_out.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_off") + inside).alias(name))
