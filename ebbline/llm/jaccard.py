"""Exact n-gram Jaccard join: sets that agree in enough shingles, as classes of documents.

A size-aware heavy-light join. A document's set holds its distinct word shingles, as 64-bit
hashes. Two sets of sizes a and b reach the similarity num/den when they share at least
``ceil(num (a + b) / (num + den))`` shingles, so they differ in at most that many less than
a + b.

1. Counting pass over all texts: shingles are counted by hash range, and a table of fixed size
   keeps for each slot of the hash space how common its most common shingle is (0: no shingle
   there occurs twice). The table is an ordering aid; whatever it holds, the result is exact.
2. Set pass over all texts: a document's shingles are ordered from rare to common. Linked sets
   share a shingle among the first ``n - ceil(num n / den) + 1`` of both; those that occur once
   in the corpus can't be it and are left out, so most documents leave the join here.
3. Equal sets fall together into their smallest document.
4. Small (light) sets: all subsets that leave out as few shingles as the similarity allows are
   enumerated; sets that meet in a subset are linked through the smallest of them.
   Large (heavy) sets: their lists in the inverted index are scanned. The boundary is the size
   with the least cost: subsets enumerated below it, list entries scanned above it.
5. Lists are scanned twice. First each set meets only one hub of its lists (the set with the
   fewest shingles of its own), which joins most copies. Then only lists that still hold several
   classes are looked at, in blocks, pair by pair inside a task: by size, by position, and by a
   parity sketch whose distance never exceeds the true difference. What passes is compared set
   against set, so every link between different classes is found, and no list of copies is
   expanded into its pairs.
"""

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm import words as W
from ebbline.llm.components import components
from ebbline.llm.sharing import tidied
from ebbline.sources.staging import stage

# The ordering table: slots by leading hash bits, and the document counts that raise a level.
SLOT_BITS = 25
LEVELS = (2, 16, 256)
# Counted shingles are cut to 48 bits; equal cuts of different shingles only raise a level.
COUNT_BITS = 48
# Shingles counted together in a task before they are handed on.
FLUSH = 1 << 20
# Largest light size ever considered; the cost decides below it.
MAX_LIGHT = 19
SKETCH_BITS = 1024
# Members of a list compared by one task.
BLOCK = 2048


def doc_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = W.text_buffers(column)
    for first, last in W.runs(offsets):
        words, bounds = W.word_hashes(data, offsets[first : last + 1])
        grams = W.gram_hashes(words, width)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield W.sequence_hash(words[a:b])
            else:
                yield np.zeros(0, np.uint64)


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences, byte planes apart, and their counts up to 65,535."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    cut = np.minimum(counts, 65535).astype("<u2")
    return zlib.compress(planes.tobytes() + cut.tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 10
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T
    values = np.cumsum(np.ascontiguousarray(planes).view("<u8").reshape(n), dtype=np.uint64)
    return values, np.frombuffer(raw, "<u2", n, 8 * n).astype(np.int64)


def _merge(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def common_levels(texts: DataFrame, width: int, ranges: int) -> np.ndarray:
    """The ordering table over all texts: one level per slot, 2**SLOT_BITS bytes."""
    bits = (ranges - 1).bit_length()
    shift = np.uint64(COUNT_BITS - bits)

    def count(batches):
        held, size = [], 0

        def rows():
            values = np.concatenate(held)
            held.clear()
            values >>= np.uint64(64 - COUNT_BITS)
            values, counts = np.unique(values, return_counts=True)
            at = np.searchsorted(values >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
            kept = [i for i in range(1 << bits) if at[i + 1] > at[i]]
            packed = [_packed(values[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]) for i in kept]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

        for batch in batches:
            for one in doc_sets(batch.column(0), width):
                held.append(one)
                size += len(one)
                if size >= FLUSH:
                    yield rows()
                    size = 0
        if size:
            yield rows()

    def level(key, group):
        values, counts = map(np.concatenate, zip(*map(_unpacked, group.column("packed").to_pylist())))
        values, counts = _merge(values, counts)
        slots = (values >> np.uint64(COUNT_BITS - SLOT_BITS)).astype(np.int64)
        found = np.searchsorted(np.array(LEVELS), counts, "right").astype(np.uint8)
        part = key[0].as_py()
        table = np.zeros(1 << (SLOT_BITS - bits), np.uint8)
        np.maximum.at(table, slots - (part << (SLOT_BITS - bits)), found)
        return pa.table({"part": pa.array([part], pa.int32()), "levels": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())})

    counted = texts.mapInArrow(tidied(count), "part int, packed binary")
    levels = counted.groupBy("part").applyInArrow(level, "part int, levels binary")
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    step = 1 << (SLOT_BITS - bits)
    # The table has a fixed size, whatever the corpus.
    for row in levels.collect():
        table[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    return table


_SETS = "id bigint, n bigint, mark_a bigint, mark_b bigint, own int, keys array<bigint>, sketch binary, members binary"


def _set_rows(docs: DataFrame, table: Broadcast, width: int, num: int, den: int) -> DataFrame:
    """One row per document with its set's marks, probing keys and, where needed, members."""

    def rows(batches):
        common = table.value
        for batch in batches:
            out = {name: [] for name in ("n", "mark_a", "mark_b", "own", "keys", "sketch", "members")}
            for one in doc_sets(batch.column(1), width):
                n = len(one)
                level = common[one >> np.uint64(64 - SLOT_BITS)]
                prefix = n + (-num * n // den) + 1
                own = int((level == 0).sum())
                keys = np.zeros(0, np.uint64)
                if own < prefix <= n:
                    shared = [one[level == i] for i in range(1, len(LEVELS) + 1)]
                    keys = np.concatenate(shared)[: prefix - own]
                needed = len(keys) or 0 < n <= MAX_LIGHT
                parity = np.bincount((one & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1 if len(keys) else None
                out["n"].append(n)
                out["mark_a"].append(int(one.sum(dtype=np.uint64).view(np.int64)) if n else None)
                out["mark_b"].append(int(W.mix(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if n else None)
                out["own"].append(own)
                out["keys"].append(keys.view(np.int64))
                out["sketch"].append(np.packbits(parity.astype(np.uint8)).tobytes() if parity is not None else None)
                out["members"].append(one.tobytes() if needed else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(out["n"], pa.int64()),
                    pa.array(out["mark_a"], pa.int64()),
                    pa.array(out["mark_b"], pa.int64()),
                    pa.array(out["own"], pa.int32()),
                    pa.array(out["keys"], pa.list_(pa.int64())),
                    pa.array(out["sketch"], pa.binary()),
                    pa.array(out["members"], pa.binary()),
                ],
                ["id", "n", "mark_a", "mark_b", "own", "keys", "sketch", "members"],
            )

    return docs.mapInArrow(tidied(rows), _SETS)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``u``, ``v`` whose sets are similar enough, member by member."""

    def compare(batches):
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                kept.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    members = sets.where("members is not null")
    left = members.select(F.col("id").alias("u"), F.col("members").alias("members_u"))
    right = members.select(F.col("id").alias("v"), F.col("members").alias("members_v"))
    both = pairs.join(left, "u").join(right, "v")
    return both.select("u", "v", "members_u", "members_v").mapInArrow(tidied(compare), "u bigint, v bigint")


def _left_out(n: int, num: int, den: int) -> int:
    """Shingles that a set of n may lack in its partner."""
    return n - -(-num * n // den)


def _light_pairs(light: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of small sets that meet in a subset: each set with the smallest one there."""

    def subsets(one: np.ndarray, drop: int) -> np.ndarray:
        total = one.sum(dtype=np.uint64)
        if not drop:
            return np.array([total])
        places = np.array(list(combinations(range(len(one)), drop)), np.int64)
        return total - one[places].sum(axis=1, dtype=np.uint64)

    def rows(batches):
        for batch in batches:
            ids, sizes, keys, shared = [], [], [], []
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.frombuffer(blob, np.uint64)
                for drop in range(_left_out(len(one), num, den) + 1):
                    found = W.mix(subsets(one, drop) + np.uint64(len(one) - drop))
                    ids += [i] * len(found)
                    sizes += [len(one)] * len(found)
                    shared += [len(one) - drop] * len(found)
                    keys.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())],
                ["id", "n", "shared", "key"],
            )

    found = light.select("id", "members").mapInArrow(tidied(rows), "id bigint, n bigint, shared bigint, key bigint")
    smallest = found.groupBy("key", "shared").agg(F.min(F.struct("n", "id")).alias("low"), F.count(F.lit(1)).alias("c"))
    met = found.join(smallest.where("c > 1"), ["key", "shared"])
    enough = F.lit(den) * F.col("shared") >= F.lit(num) * (F.col("n") + F.col("low.n") - F.col("shared"))
    return met.where(enough).select(F.col("id").alias("u"), F.col("low.id").alias("v")).where("u <> v").distinct()


def _boundary(entries: DataFrame, lists: DataFrame, light: DataFrame, num: int, den: int) -> int:
    """The largest light size: where subsets below plus scanned entries above cost least."""
    scanned = entries.where(F.col("n") <= MAX_LIGHT).join(lists.select("key", "c"), "key")
    scans = {r["n"]: r["cost"] for r in scanned.groupBy("n").agg(F.sum("c").alias("cost")).collect()}
    sizes = {r["n"]: r["count"] for r in light.groupBy("n").count().collect()}  # MAX_LIGHT rows at most
    best, at = None, 0
    for b in range(MAX_LIGHT + 1):
        below = sum(c * sum(comb(n, d) for d in range(_left_out(n, num, den) + 1)) for n, c in sizes.items() if n <= b)
        cost = below + sum(c for n, c in scans.items() if n > b)
        if best is None or cost <= best:
            best, at = cost, b
    return at


def _blocked_pairs(entries: DataFrame, num: int, den: int, first_only: bool) -> DataFrame:
    """Pairs of different classes on one list that no cheap bound rules out.

    ``entries`` carry key, cell, block, id, n, at, class and sketch; a task sees a cell's rows
    one after another. Linked sets pass at their first common key: all shingles before it in
    either set are missing from the other.
    """

    def rows(batches):
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            key, cell = (table.column(i).to_numpy() for i in (0, 1))
            cut = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            carried = table.slice(cut)
            if cut:
                yield scan(table.slice(0, cut))
        if carried is not None and len(carried):
            yield scan(carried)

    def scan(table):
        key, cell, block, ids, n, at, kind = (table.column(i).to_numpy() for i in range(7))
        sketch = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(len(ids), -1)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        starts = np.flatnonzero(new)
        left = np.repeat(np.append(starts[1:], len(ids)), np.diff(np.append(starts, len(ids)))) - np.arange(len(ids))
        mixed = (cell // (1 << 20)) != (cell % (1 << 20))
        us, vs = [], []
        rows, lag = np.flatnonzero(left > 1), 1
        while len(rows):
            a, b = rows, rows + lag
            size = n[a] + n[b]
            most = size - 2 * -(-num * size // (num + den))
            good = (kind[a] != kind[b]) & (at[a] + at[b] <= most)
            good &= (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & ~(mixed[a] & (block[a] == block[b]))
            a, b, most = a[good], b[good], most[good]
            if len(a):
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)
                a, b = a[apart <= most], b[apart <= most]
                us.append(ids[a])
                vs.append(ids[b])
            lag += 1
            rows = rows[left[rows] > lag]
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        u, v = np.maximum(u, v), np.minimum(u, v)
        if first_only and len(u):
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            one = np.concatenate([[True], u[1:] != u[:-1]])
            u, v = u[one], v[one]
        elif len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = entries.repartition("key", "cell").sortWithinPartitions("key", "cell")
    columns = ["key", "cell", "block", "id", "n", "at", "kind", "sketch"]
    found = dealt.select(columns).mapInArrow(tidied(rows), "u bigint, v bigint")
    if first_only:
        return found.groupBy("u").agg(F.min("v").alias("v")).select("u", "v")
    return found.distinct()


def _still_apart(shared: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of the lists that hold several classes, laid out in blocks and cells."""
    joined = shared.join(found, "id", "left").withColumn("kind", F.coalesce("component", "id"))
    live = joined.groupBy("key").agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.count(F.lit(1)).alias("c"))
    live = live.where("a <> b").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    sketches = sets.where("sketch is not null").select("id", "n", "sketch")
    rows = joined.drop("component").join(live, "key").join(sketches, ["id", "n"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # A cell is a pair of blocks; a member goes to the cells of its block with every other.
    cells = F.expr(
        "transform(sequence(0, blocks - 1), j -> least(block, j) * 1048576L + greatest(block, j))"
    )
    return rows.select("*", F.explode(cells).alias("cell"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``.

    Sets of ``width``-word shingles link when ``den * shared >= num * union``. A-Z count as a-z;
    words stand between ASCII white space; a text with fewer words is one shingle. A component is
    named by its smallest id. Null, empty or wordless texts have ``n_shingles`` 0 and stand alone.
    Rows that share an id are one vertex with several sets; a null id links with nothing and has
    a null component. Other columns are not looked at, and an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    parts = max(64, min(1 << 14, 1 << (4 * plain.rdd.getNumPartitions() - 1).bit_length()))
    levels = docs.sparkSession.sparkContext.broadcast(common_levels(plain.select("text"), width, parts))
    rows = stage(_set_rows(plain, levels, width, num, den), "sets")
    levels.destroy()
    marks = ["mark_a", "mark_b", "n"]
    reps = rows.where("n > 0 and id is not null").groupBy(*marks).agg(F.min("id").alias("rep"))
    reps = stage(reps, "reps")
    # One set per class of equal ones: that of its smallest document.
    sets = rows.where("members is not null").join(reps.withColumnRenamed("rep", "id"), [*marks, "id"])
    sets = stage(sets.dropDuplicates([*marks, "id"]).select("id", "n", "own", "keys", "sketch", "members"), "classes")

    entries = sets.select("id", "n", "own", F.posexplode("keys").alias("at", "key"))
    entries = entries.withColumn("at", F.col("at") + F.col("own"))
    hub = F.struct("own", "id", "n", "at")
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(hub).alias("hub"))
    lists = stage(lists.where("c > 1"), "lists")
    shared = stage(entries.join(lists.select("key", "hub"), "key"), "entries")

    small = sets.where(F.col("n") <= MAX_LIGHT)
    boundary = _boundary(shared, lists, small, num, den)
    light = _verified(_light_pairs(small.where(F.col("n") <= boundary), num, den), sets, num, den)

    # A heavy set may link with a light one of nearly its size.
    heavy = shared.where(F.col("n") * den >= num * (boundary + 1))
    size = F.col("n") + F.col("hub.n")
    most = size - 2 * F.ceil(num * size / F.lit(num + den))
    near = (F.col("at") + F.col("hub.at") <= most) & (den * F.least("n", "hub.n") >= num * F.greatest("n", "hub.n"))
    hubs = heavy.where(near & (F.col("id") != F.col("hub.id"))).groupBy("id").agg(F.min("hub").alias("hub"))
    hubs = hubs.select(F.col("id").alias("u"), F.col("hub.id").alias("v"))

    # Rows of one id whose texts differ are one vertex.
    same = rows.where("n > 0 and id is not null").join(reps, marks).groupBy("id")
    same = same.agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("u", "v")
    edges = stage(_verified(hubs, sets, num, den).union(light).union(same), "links")
    heavy = heavy.drop("hub")
    for first_only in (True, False):
        apart = _still_apart(heavy, sets, components(edges))
        more = _verified(_blocked_pairs(apart, num, den, first_only), sets, num, den)
        edges = stage(edges.union(more), "links")
    found = components(edges).withColumnsRenamed({"id": "rep", "component": "component_id"})
    placed = rows.select("id", *marks).join(reps, marks, "left").join(found, "rep", "left")
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "rep", "id")).alias("component_id"),
    )
