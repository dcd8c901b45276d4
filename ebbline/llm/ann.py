"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-rotations (three rounds of random signs and a fast Hadamard
transform) and belongs to the signed axis nearest to it. Each of ``TABLES`` tables combines as
many of these hashes as keep its buckets near ``ROWS_PER_BUCKET`` rows. A query probes the
buckets of the axes next best to it in every table. Where a bucket's rows and the queries that
probe it meet, distances are computed in blocks and only each query's nearest leave, so
candidate pairs are never rows. How many buckets to probe is measured: against brute force for a
bounded sample of queries over all rows.

Rows with equal vectors are one class and stand in a bucket once; of its members only the
nearest few by id can be among a query's nearest, so the copies of a hot vector cost nothing. A
bucket of more than ``BUCKET_ROWS`` classes is dealt over several tasks, each met by the queries.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.words import mix
from ebbline.sources.staging import stage

TABLES = 6
ROUNDS = 3
ROWS_PER_BUCKET = 400
BUCKET_ROWS = 20_000
# Queries of the sample on which probes are measured, and the recall wanted there.
SAMPLE = 64
RECALL = 0.95
# Axes per hash among which probes are ordered, by the number of hashes combined.
AXES = {1: 4096, 2: 32, 3: 12}


def rotate(unit: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotated rows, padded with zeros to a power of two."""
    n, d = unit.shape
    size = 1 << max(d - 1, 1).bit_length()
    rows = np.zeros((n, size))
    rows[:, :d] = unit
    for i in range(ROUNDS):
        marks = mix(np.arange(size, dtype=np.uint64) + np.uint64((seed * ROUNDS + i) * 0x1000003 + 17))
        rows = rows * np.where(marks >> np.uint64(63), 1.0, -1.0)
        half = 1
        while half < size:
            pairs = rows.reshape(n, -1, 2, half)
            rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        rows /= math.sqrt(size)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(rows: np.ndarray, hashes: int) -> np.ndarray:
    """Bucket of each row in each table."""
    unit, out = _unit(rows), []
    for table in range(TABLES):
        code = np.zeros(len(rows), np.int64)
        for j in range(hashes):
            turned = rotate(unit, table * 8 + j)
            axis = np.abs(turned).argmax(axis=1)
            signed = 2 * axis + (turned[np.arange(len(rows)), axis] < 0)
            code = code * (2 * turned.shape[1]) + signed
        out.append(code)
    return np.stack(out, axis=1)


def probes(rows: np.ndarray, hashes: int, most: int) -> np.ndarray:
    """The ``most`` likeliest buckets of each row in each table, best first (-1: no more)."""
    unit = _unit(rows)
    out = np.full((len(rows), TABLES, most), -1, np.int64)
    for table in range(TABLES):
        cost, code = np.zeros((len(rows), 1)), np.zeros((len(rows), 1), np.int64)
        for j in range(hashes):
            turned = rotate(unit, table * 8 + j)
            size = turned.shape[1]
            both = np.stack([turned, -turned], axis=2).reshape(len(rows), -1)
            best = np.argsort(-both, axis=1, kind="stable")[:, : AXES[hashes]]
            value = np.take_along_axis(both, best, axis=1)
            gap = (value[:, :1] - value) ** 2
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(rows), -1)
            code = (code[:, :, None] * (2 * size) + best[:, None, :]).reshape(len(rows), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :most]
        found = np.take_along_axis(code, order, axis=1)
        out[:, table, : found.shape[1]] = found
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length from a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Indices and exact Euclidean distances of each query's ``k`` nearest rows, ties by id."""
    about = (queries**2).sum(1)[:, None] - 2 * queries @ rows.T + (rows**2).sum(1)
    for i, q in enumerate(queries):
        at = np.arange(len(rows))
        if len(rows) > k:
            # The expansion above may be off in the last digits: what is near the limit is kept.
            limit = np.partition(about[i], k - 1)[k - 1]
            at = np.flatnonzero(about[i] <= limit + 1e-9 * (abs(limit) + (q**2).sum() + 1e-300))
        exact = np.sqrt(((rows[at] - q) ** 2).sum(1))
        order = np.lexsort((ids[at], exact))[:k]
        yield at[order], exact[order]


def _by_length(batch: pa.RecordBatch, column: str):
    lengths = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(lengths):
        yield int(n), batch.filter(pa.array(lengths == n))


def _sampled_probes(classes: DataFrame, sample: DataFrame, hashes: int, k: int) -> int:
    """Probes a table that reach ``RECALL`` on the sample, by brute force over all classes."""
    held = sample.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vector").toPandas()
    wanted = {}
    for i, v in zip(held["id"], held["vector"]):
        wanted.setdefault(len(v), []).append((i, np.array(v, np.float64)))
    if not wanted:
        return 1

    def rows(batches):
        for batch in batches:
            for n, part in _by_length(batch, "vector"):
                if n not in wanted:
                    continue
                ids, vectors = part.column("id").to_numpy(), _matrix(part.column("vector"))
                own = np.stack([v for _, v in wanted[n]])
                out = {"query": [], "id": [], "score": [], "vector": []}
                for (q, _), (at, score) in zip(wanted[n], nearest_rows(own, vectors, ids, k + 1)):
                    out["query"] += [q] * len(at)
                    out["id"] += ids[at].tolist()
                    out["score"] += score.tolist()
                    out["vector"] += vectors[at].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["query"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["vector"], pa.list_(pa.float64()))],
                    ["query", "id", "score", "vector"],
                )

    found = classes.select("id", "vector").mapInArrow(rows, "query bigint, id bigint, score double, vector array<double>")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    true = found.where("query <> id").withColumn("place", place).where(F.col("place") <= k).toPandas()
    ranks = []
    own = {i: v for part in wanted.values() for i, v in part}
    for q, part in true.groupby("query"):
        tried = probes(own[q][None], hashes, 1 << 14)[0]
        there = codes(np.stack([np.array(v) for v in part["vector"]]), hashes)
        for code in there:
            hit = [np.flatnonzero(tried[t] == code[t]) for t in range(TABLES)]
            ranks.append(min([h[0] for h in hit if len(h)], default=1 << 14))
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)) - 1)]) + 1


def nearest_neighbours(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest rows found.

    ``is_query`` is a condition on the id column; every other row of the same length is a
    candidate. Scores are Euclidean distances of the vectors as given, in double precision;
    ties go to the smaller id. Null, empty or zero vectors, and those holding null or a
    non-finite number, take no part. Repeated rows count once; rows that share an id but not the
    vector are candidates each, never for their own id. Few candidates give fewer rows, an empty
    table none. Other columns are not looked at.
    """
    vector = F.col(vector_column).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.select(F.col(id_column).cast("bigint").alias("id"), vector.alias("vector"), is_query.alias("asks"))
    plain = plain.where(sound & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())
    # The nearest k others are among the k + 1 smallest ids of the k + 1 nearest classes.
    few = k + 1
    once = plain.select("id", "vector", "asks")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    members = once.dropDuplicates(["id", "vector"]).withColumn("place", place).where(F.col("place") <= few)
    classes = members.groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members"))
    classes = stage(classes.select("id", "vector", "members"), "classes")
    asking = once.where("asks").dropDuplicates(["id", "vector"]).join(classes.select(F.col("id").alias("class"), "vector"), "vector")
    asking = stage(asking.select(F.col("id").alias("query_id"), "class", "vector"), "queries")
    queries = asking.select(F.col("class").alias("id"), "vector").dropDuplicates(["id"])

    rows = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    axes = 2 << max((rows["d"] or 1) - 1, 1).bit_length()
    hashes = min(max(1, round(math.log(max(rows["n"], 1) / ROWS_PER_BUCKET + 1e-9) / math.log(axes))), max(AXES))
    most = _sampled_probes(classes, queries, hashes, k)

    def placed(asks: bool):
        def rows(batches):
            for batch in batches:
                for n, part in _by_length(batch, "vector"):
                    matrix = _matrix(part.column("vector"))
                    found = probes(matrix, hashes, most) if asks else codes(matrix, hashes)[:, :, None]
                    at, table, turn = np.nonzero(found >= 0)
                    for first in range(0, len(at), 10_000):
                        cut = slice(first, first + 10_000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at[cut]), n), pa.int32()),
                                pa.array(table[cut], pa.int32()),
                                pa.array(found[at[cut], table[cut], turn[cut]], pa.int64()),
                                part.column("id").take(pa.array(at[cut])),
                                part.column("vector").take(pa.array(at[cut])),
                            ],
                            ["length", "table", "code", "id", "vector"],
                        )

        return rows

    kind = "length int, table int, code bigint, id bigint, vector array<double>"
    bucket = ["length", "table", "code"]
    index = classes.select("id", "vector").mapInArrow(placed(False), kind)
    asked = queries.select("id", "vector").mapInArrow(placed(True), kind)
    sizes = index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUCKET_ROWS)
    sizes = stage(sizes.select(*bucket, F.ceil(F.col("c") / BUCKET_ROWS).cast("int").alias("parts")), "buckets")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(sizes, bucket, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    asked = asked.join(sizes, bucket, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = [*bucket, "part"]

    def meet(key, left, right):
        out = {"query": [], "id": [], "score": []}
        if len(left) and len(right):
            ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
            matrix = _matrix(left.column("vector").combine_chunks())
            wanted = _matrix(right.column("vector").combine_chunks())
            for first in range(0, len(own), 256):
                cut = slice(first, first + 256)
                for q, (at, score) in zip(own[cut], nearest_rows(wanted[cut], matrix, ids, few)):
                    out["query"] += [int(q)] * len(at)
                    out["id"] += ids[at].tolist()
                    out["score"] += score.tolist()
        return pa.table({"query": pa.array(out["query"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    met = index.drop("parts").groupBy(*cell).cogroup(asked.drop("parts").groupBy(*cell))
    met = met.applyInArrow(meet, "query bigint, id bigint, score double").groupBy("query", "id").agg(F.min("score").alias("score"))
    by_class = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    met = met.withColumn("place", by_class).where(F.col("place") <= few).drop("place")
    found = met.join(classes.select("id", "members"), "id").select("query", "score", F.explode("members").alias("vec_id"))
    by_member = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    found = found.withColumn("place", by_member).where(F.col("place") <= few).drop("place")
    answers = asking.select("query_id", F.col("class").alias("query")).join(found, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
