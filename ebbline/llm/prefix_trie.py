"""The trie of shared conversation beginnings, by digests of blocks of several turns.

Conversations are cut into blocks of ``BLOCK`` turns. A block is known by the digest of all turns
before it and that of all turns up to its end, so conversations with equal beginnings meet block
by block, combined before any shuffle. Where one block alone follows a beginning, its turns are
nodes as they stand; only where several blocks follow the same beginning (siblings) are they
opened and their turns compared. Texts aren't moved: turns are 128-bit digests from the first scan.

A digest of a beginning is the exclusive or of its turns' hashes, each salted by its place; so it
is a running total, and a conversation of any length is summed in parts.

Every conversation owns the nodes of which it is the smallest member: a piece of its own path, down
to its end. Sums over a node's subtree are then sums over its members of what each owns.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.skew import join_by_heat
from ebbline.operators.ordered import global_positions
from ebbline.sources.staging import stage

BLOCK = 4
# Blocks of a conversation (or nodes of a path) that one window sums.
RUN = 1024
# Ends of a node whose ids one row holds.
CHUNK = 8192
_NODE = ["depth", "x", "y"]


def number_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv_id``, ``place`` from 0, ``x``, ``y``, ``n_bytes``) and conversations
    (``conv_id``, ``n_turns``), from conv_id, turn, role, text.

    Turns are in order of ``turn`` (null first), then role, then the digest of the text; null role
    or text is empty, rows without a conv_id belong to no conversation. A conversation of very
    many rows is ordered by many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), role, text).alias("y"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    placed = global_positions(stage(turns, "turns"), ["conv_id", "turn", "role", "x", "y"])
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min("position").alias("start"))
    sizes = stage(sizes, "conversations")
    starts = sizes.select("conv_id", "start", "n_turns")
    turns = join_by_heat(placed, starts, ["conv_id"], "n_turns")
    turns = turns.select("conv_id", (F.col("position") - F.col("start")).alias("place"), "x", "y", "n_bytes")
    return stage(turns, "places"), sizes.select("conv_id", "n_turns")


def _before(rows: DataFrame, key: str, at: str, run: Column, fold: dict[str, str], by=F.sum) -> DataFrame:
    """``rows`` with the totals over the rows of the key that come before by ``at``.

    Rows are summed inside runs of at most ``RUN``, runs by their totals: a key of any number of
    rows is shared by many tasks. ``fold`` maps a new column to the one summed, ``by`` is sum or
    bit_xor. Rows must be dealt by key and run, or will be.
    """
    rows = rows.withColumn("run", run)
    inside = Window.partitionBy(key, "run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "run").agg(*[by(of).alias(c) for c, of in fold.items()])
    earlier = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # Few keys have a second run.
    totals = totals.select(key, "run", *[by(c).over(earlier).alias(f"_{c}") for c in fold]).where("run > 0")
    rows = rows.withColumns({c: by(of).over(inside) for c, of in fold.items()}).join(totals, [key, "run"], "left")

    def added(c: str) -> Column:
        near, far = F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))
        return near + far if by is F.sum else near.bitwiseXOR(far)

    return rows.withColumns({c: added(c) for c in fold}).drop("run", *[f"_{c}" for c in fold])


def _paths(turns: DataFrame) -> DataFrame:
    """Blocks of every conversation: the digest before (``in_x``, ``in_y``) and ``path``, the nodes
    of its turns (depth, digest, parent's digest, bytes of the text)."""
    place = F.col("place")
    salted = turns.select(
        "conv_id",
        "n_turns",
        "place",
        "n_bytes",
        F.xxhash64(F.lit(3), place, "x", "y").alias("x"),
        F.xxhash64(F.lit(4), place, "x", "y").alias("y"),
        F.floor(place / BLOCK).alias("block"),
    )
    run = F.floor(F.col("block") / RUN)
    # The deal of the runs serves the blocks too.
    salted = salted.repartition("conv_id", run)
    turn = F.struct("place", "x", "y", "n_bytes")
    blocks = salted.groupBy("conv_id", run.alias("run"), "block").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        F.max("n_turns").alias("n_turns"),
        F.bit_xor("x").alias("all_x"),
        F.bit_xor("y").alias("all_y"),
    )
    fold = {"in_x": "all_x", "in_y": "all_y"}
    blocks = _before(blocks.drop("run"), "conv_id", "block", run, fold, F.bit_xor)

    def digest(c: str, upto: Column) -> Column:
        return F.aggregate(F.slice("turns", 1, upto), F.col(f"in_{c}"), lambda total, t: total.bitwiseXOR(t[c]))

    def node(t: Column, i: Column) -> Column:
        return F.struct(
            (t["place"] + 1).alias("depth"),
            digest("x", i + 1).alias("x"),
            digest("y", i + 1).alias("y"),
            digest("x", i).alias("up_x"),
            digest("y", i).alias("up_y"),
            t["n_bytes"].alias("n_bytes"),
        )

    path = F.transform("turns", node)
    ends = F.element_at("turns", -1)["place"] + 1 == F.col("n_turns")
    out = blocks.select("conv_id", "block", "in_x", "in_y", path.alias("path"), ends.alias("ends"))
    last = F.element_at("path", -1)
    return out.withColumns({"out_x": last["x"], "out_y": last["y"], "length": F.size("path")})


def _ends_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` per node: of its ids in ascending order, joined by commas.

    A digest is read from front to back, but not id by id: ids are ordered by many tasks, which
    join them to chunks; a node's task reads its chunks.
    """
    fields = "depth bigint, x bigint, y bigint"
    names = [*_NODE, "first", "ids"]

    def chunks(batches):
        node, ids = None, []

        def chunk():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int64()) for v in (*node, ids[0])), pa.array([",".join(map(str, ids))])], names
            )

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != node or len(ids) == CHUNK):
                    yield chunk()
                    ids = []
                node = key
                ids.append(conv)
        if ids:
            yield chunk()

    def digests(batches):
        node, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([total.hexdigest()])], [*_NODE, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node is not None:
                        yield done()
                    node, total = key, hashlib.sha256(ids.encode())
                else:
                    total.update(f",{ids}".encode())
        if node is not None:
            yield done()

    ordered = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    dealt = ordered.mapInArrow(chunks, f"{fields}, first bigint, ids string").repartition(*_NODE)
    dealt = dealt.sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
    return dealt.mapInArrow(digests, f"{fields}, ends_sha256 string")


def build_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie: every distinct sequence of first turns, and the root.

    ``turns`` has conv_id, ``n_turns`` of its conversation, place (0 to n_turns - 1), x, y (a
    turn's digest) and n_bytes; ``sizes`` has conv_id and n_turns of every conversation, those
    without turns too, which end at the root. Out come ``conv_id`` (smallest member; its turn
    ``depth`` is the node's text), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. No conversations: no node.
    """
    blocks = stage(_paths(turns), "blocks")
    key = ["block", "in_x", "in_y", "out_x", "out_y", "length"]
    distinct = blocks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path")
    )
    distinct = stage(distinct, "distinct")

    # Blocks that follow the same beginning differ somewhere; a block alone doesn't.
    begin = ["block", "in_x", "in_y"]
    siblings = distinct.groupBy(*begin).agg(F.count(F.lit(1)).alias("siblings")).where("siblings > 1")
    siblings = stage(siblings.withColumn("several", F.lit(True)), "siblings")
    marked = join_by_heat(distinct, siblings, begin, "siblings", "left")
    opened = marked.select(F.col("several").isNotNull().alias("several"), "n_convs", "conv_id", F.inline("path"))
    same = opened.where("several").groupBy(*_NODE, "up_x", "up_y", "n_bytes").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    nodes = opened.where("not several").drop("several").unionByName(same)
    root = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.withColumns({c: zero for c in (*_NODE, "n_bytes")} | {c: F.lit(None).cast("bigint") for c in ("up_x", "up_y")})
    nodes = stage(nodes.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumns(
        {
            "n_children": F.coalesce("n_children", zero),
            "saved": (F.col("n_convs") - 1) * F.col("n_bytes"),
        }
    )
    # What the smallest member owns above the node.
    nodes = stage(_before(nodes, "conv_id", "depth", F.floor(F.col("depth") / RUN), {"above": "saved"}), "nodes")

    ended = blocks.where("ends").select("conv_id", F.inline(F.slice("path", -1, 1)))
    turnless = sizes.where("n_turns = 0").select("conv_id", *[zero.alias(c) for c in _NODE])
    ends = stage(ended.select("conv_id", *_NODE).union(turnless), "ends")
    owned = nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("own_saved"), F.count_if(F.col("n_children") == 0).alias("own_leaves")
    )
    owned = ends.select("conv_id", F.ceil(F.col("depth") / BLOCK).alias("n_blocks")).join(owned, "conv_id")
    owned = stage(owned, "owned")
    held = join_by_heat(blocks.select("conv_id", *key), owned, ["conv_id"], "n_blocks")
    sums = [F.sum("own_saved").alias("all_saved"), F.sum("own_leaves").alias("n_leaves")]
    totals = held.groupBy(*key).agg(*sums).join(distinct.select(*key, "path"), key)
    totals = totals.select(F.col("all_saved").alias("own_saved"), F.col("n_leaves").alias("own_leaves"), F.inline("path"))
    totals = totals.groupBy(*_NODE).agg(*sums)
    totals = totals.unionByName(owned.agg(*sums).withColumns({c: zero for c in _NODE}))

    up = ["up_depth", "up_x", "up_y"]
    parents = nodes.where("n_children > 0").select(
        F.col("depth").alias("up_depth"),
        F.col("x").alias("up_x"),
        F.col("y").alias("up_y"),
        F.col("conv_id").alias("parent_conv_id"),
        "n_children",
    )
    below = nodes.withColumn("up_depth", F.col("depth") - 1).select(*_NODE, *up)
    above = join_by_heat(below.where("depth > 0"), stage(parents, "parents"), up, "n_children")
    found = nodes.join(totals, _NODE).join(above.select(*_NODE, "parent_conv_id"), _NODE, "left")
    found = found.join(_ends_digests(ends), _NODE, "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``build_trie`` of a table of conv_id, turn, role, text; see ``number_turns`` for odd rows."""
    turns, sizes = number_turns(conversations)
    return build_trie(join_by_heat(turns, sizes.withColumn("size", F.col("n_turns")), ["conv_id"], "size"), sizes)
