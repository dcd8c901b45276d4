"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has order five over the bytes of a text (``symbols.BYTES``), none folded. Its counts come
from every trusted document: each task sums its own, the sums meet sharded by n-gram. Each level's
discounts, context totals and lower-order probabilities are joins of count tables on n-grams and
contexts, and so is scoring: n-grams of the documents, each once for a block of some megabytes of
text, are joined with the levels of the model, and their bits return to their block. Only the
discounts, three numbers a level, come to the driver, and no part of the model is broadcast.
Thresholds are an upper quantile, per language and length, of trusted documents that the model
hasn't seen.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm import symbols as S
from ebbline.llm.sharing import let_go_in_worker, tidied
from ebbline.sources.staging import stage, stage_by

SEED = 1
FOLDS = 5
# Trusted ids are broadcast up to this many, counted; beyond, the join is by shuffle.
BROADCAST_IDS = 1_000_000
# The share of trusted texts that may be dropped: limits are the quantile above which it lies.
FALSE_DROP = 0.005
# The least held-out trusted documents from which a language, or a length of it, has its own limit.
ENOUGH = 100
# Lengths are told apart by powers of 2**LENGTH_BITS symbols.
LENGTH_BITS = 2
# With fewer than ENOUGH in all, the quantile isn't known: the median plus REACH times the way from
# there to HIGH.
MIDDLE, HIGH, REACH = 0.5, 0.95, 6.0
# Bits, over the root of a text's symbols, that are added to the limit where its length has none
# of its own: a mean of so few symbols strays that far by chance.
SLACK_BITS = 6.0
# Symbols whose n-grams a task sorts together.
FLUSH = 1 << 21
# Texts whose n-grams are looked up together: a block ends with the text that reaches so many bytes,
# or with the run of texts that reaches so many different n-grams.
BLOCK = 1 << 25
BLOCK_GRAMS = 1 << 20
# What a text counts beside its bytes.
BLOCK_ROW = 64
# Documents wait and travel packed, as their text is most of what scoring moves.
PACK_LEVEL = 9
# N-grams handed to Spark at a time.
BATCH = 100_000


def fold(id_column: str):
    """0 for documents kept out of the model, by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(SEED)), F.lit(FOLDS))


def _batches(columns: dict[str, np.ndarray]):
    n = len(next(iter(columns.values())))
    for start in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[start : start + BATCH], pa.int64()) for x in columns.values()], list(columns))


def count_grams(texts: DataFrame, alphabet: S.Alphabet = S.FOLDED) -> DataFrame:
    """``gram``, ``c``: how often ``order`` symbols follow each other."""

    def rows(batches):
        let_go_in_worker()
        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return _batches({"gram": values, "c": counts})

        for batch in batches:
            for found in S.inner_grams(batch.column(0), alphabet):
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield from counted()
                    held, size = [], 0
        if size:
            yield from counted()

    return texts.mapInArrow(tidied(rows), "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from counts of counts."""
    row = counts.agg(*[F.sum((F.col("c") == i).cast("bigint")) for i in range(1, 5)]).first()
    n = [x or 0 for x in row]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
    return [min(max(d, 0.05 * (k + 1)), 0.95 * (k + 1)) for k, d in enumerate(raw)]


def kneser_ney(counts: DataFrame, alphabet: S.Alphabet = S.FOLDED) -> list[tuple[DataFrame, DataFrame]]:
    """Per level from one symbol to ``order``: (``gram``, ``p``) seen and (``context``, ``rest``).

    ``rest`` is the weight that a context leaves to the level below. Levels under the highest
    count in how many different symbols' company an n-gram was seen.
    """
    tables = [counts]
    for order in range(alphabet.order - 1, 0, -1):
        shorter = _tail("gram", order, alphabet)
        tables.append(stage(tables[-1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    levels, below = [], None
    for own in reversed(tables):
        d = discounts(own)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        placed = own.withColumn("context", F.shiftright("gram", alphabet.bits)).withColumn("cut", cut)
        contexts = placed.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("rest"))
        contexts = stage(contexts, "contexts")
        joined = placed.join(contexts, "context")
        kept = (F.col("c") - F.col("cut")) / F.col("total")
        if below is None:
            joined = joined.withColumn("p", kept + F.col("rest") / alphabet.size)
        else:
            tail = _tail("gram", len(levels), alphabet)
            lower = below.select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
            joined = joined.withColumn("tail", tail).join(lower, "tail")
            joined = joined.withColumn("p", kept + F.col("rest") * F.col("lower"))
        below = stage(joined.select("gram", "p"), "level")
        levels.append((below, contexts.select("context", "rest")))
    return levels


def _tail(gram: str, order: int, alphabet: S.Alphabet):
    return F.col(gram).bitwiseAND(F.lit((1 << (alphabet.bits * order)) - 1))


def look_up(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]], alphabet: S.Alphabet = S.FOLDED) -> DataFrame:
    """``gram`` and its ``p``, for different grams of as many symbols as there are ``levels``.

    What a level hasn't seen has the weight that its context leaves, all of it for an unseen
    context, times the probability of its tail on the level below.
    """
    seen, contexts = levels[-1]
    met = stage(wanted.join(seen, "gram", "left"), "met")
    order = len(levels) - 1
    unseen = met.where("p is null").select(
        "gram", F.shiftright("gram", alphabet.bits).alias("context"), _tail("gram", order, alphabet).alias("tail")
    )
    unseen = unseen.join(contexts, "context", "left")
    if order:
        lower = look_up(unseen.select(F.col("tail").alias("gram")).distinct(), levels[:-1], alphabet)
        unseen = unseen.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
    else:
        unseen = unseen.withColumn("lower", F.lit(1.0 / alphabet.size))
    p = F.coalesce("rest", F.lit(1.0)) * F.col("lower")
    return met.where("p is not null").unionByName(unseen.select("gram", p.alias("p")))


def probabilities(levels: list[tuple[DataFrame, DataFrame]], alphabet: S.Alphabet = S.FOLDED) -> np.ndarray:
    """Bits of information of the last symbol of every possible gram, in order of their codes.

    For checks of a model over few symbols; scoring looks up the grams that documents hold.
    """
    session = levels[-1][0].sparkSession
    wanted = session.range(1 << (alphabet.bits * len(levels))).withColumnRenamed("id", "gram")
    found = look_up(wanted, levels, alphabet).toArrow()
    bits = np.empty(len(found), np.float32)
    bits[found["gram"].to_numpy()] = -np.log2(found["p"].to_numpy())
    return bits


def in_blocks(docs: DataFrame, alphabet: S.Alphabet) -> DataFrame:
    """Blocks of consecutive documents, as rows of some megabytes at most: ``block`` and either ``packed``,
    some of its documents, or ``grams``, some of its different n-grams.

    Staged, so that a document belongs to one block whatever is computed again, and dealt by block,
    so that the documents wait where the bits of their n-grams come to.
    """

    def rows(batches):
        let_go_in_worker()
        task, n, grams, size = TaskContext.get().partitionId(), 0, [], 0

        def row(packed, grams):
            columns = [pa.array([(task << 32) + n], pa.int64()), pa.array([packed], pa.binary()), pa.array([grams], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "packed", "grams"])

        def pack(part):
            sink = pa.BufferOutputStream()
            packing = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))
            with pa.ipc.new_stream(sink, part.schema, options=packing) as writer:
                writer.write_batch(part)
            return sink.getvalue().to_pybytes()

        def asked():
            for start in range(0, len(grams[0]), BATCH):
                yield row(None, grams[0][start : start + BATCH])

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + BLOCK_ROW
            # Pieces of some megabytes, or of one text.
            piece = (np.cumsum(sizes) - sizes) // min(FLUSH, BLOCK)
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(sizes)]):
                part = batch.slice(start, end - start)
                yield row(pack(part), None)
                own = [np.unique(found) for found in S.inner_grams(part.column("text"), alphabet)]
                grams = [np.unique(np.concatenate([*grams, *own]))]
                size += int(sizes[start:end].sum())
                if size >= BLOCK or len(grams[0]) >= BLOCK_GRAMS:
                    yield from asked()
                    n, grams, size = n + 1, [], 0
        if size:
            yield from asked()

    return stage_by(docs.mapInArrow(tidied(rows), "block bigint, packed binary, grams array<bigint>"), "block", "blocks")


def score(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], alphabet: S.Alphabet = S.BYTES) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with ``n_symbols``, ``bits`` instead of text."""
    others = [c for c in docs.columns if c != "text"]
    kinds = [docs.schema[c] for c in others]
    blocks = in_blocks(docs, alphabet)
    asked = blocks.select(F.col("block").alias("asking"), F.explode("grams").alias("gram"))
    found = stage(look_up(asked.select("gram").distinct(), levels, alphabet), "found")
    known = asked.join(found.select("gram", (-F.log2("p")).cast("float").alias("bits")), "gram")

    def rows(packed, known):
        order = np.argsort(known["gram"].to_numpy())
        grams, bits = known["gram"].to_numpy()[order], known["bits"].to_numpy()[order].astype(np.float64)
        out = []
        for part in itertools.chain.from_iterable(pa.ipc.open_stream(x.as_buffer()) for x in packed["packed"]):
            counts, sums = [], []
            for symbols, bounds in S.runs(part.column("text"), alphabet):
                # Grams across two texts may be found nowhere, and are in no text's sum.
                at = np.minimum(np.searchsorted(grams, S.grams(symbols, alphabet.order, alphabet.bits)), len(grams) - 1)
                total = np.concatenate([[0.0], np.cumsum(bits[at])])
                counts.append(np.diff(bounds) - alphabet.order + 1)
                sums.append(total[bounds[1:] - alphabet.order + 1] - total[bounds[:-1]])
            kept = [part.column(c) for c in others]
            kept += [pa.array(np.concatenate(x), k) for x, k in ((counts, pa.int64()), (sums, pa.float64()))]
            out.append(pa.RecordBatch.from_arrays(kept, [*others, "n_symbols", "bits"]))
        return pa.Table.from_batches(out)

    fields = ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in kinds])
    both = blocks.where("packed is not null").select("block", "packed").groupBy("block").cogroup(known.groupBy("asking"))
    return both.applyInArrow(rows, f"{fields}, n_symbols bigint, bits double")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, ``threshold``, ``keep`` for every row of ``docs``.

    ``labels`` (doc_id, quality) name trusted documents by quality 1. A limit, in bits a byte, is
    the 1 - ``FALSE_DROP`` quantile of trusted held-out documents of the same language and length.
    Where those are fewer than ``ENOUGH``, it is the language's over all lengths, or, with too few
    of them and for null, that over all, either with ``SLACK_BITS`` over the root of the symbols
    added. A text goes if its bits a byte exceed its limit (perplexity above threshold), or if
    it is null, empty or white space. Rows that repeat an id are judged each by its own text; with no
    trusted text nothing but blank texts goes (null perplexity). Other columns are not looked at.
    """
    plain = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
    )
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna().distinct()
    trusted = stage(trusted, "trusted")
    n = trusted.count()
    learned = trusted.where(fold("doc_id") != 0)
    learned = F.broadcast(learned) if n <= BROADCAST_IDS else learned
    counts = stage(count_grams(plain.join(learned, "doc_id", "left_semi").select("text"), S.BYTES), "grams")
    blank = ~F.col("text").rlike(r"\S")
    if not counts.head(1):
        none = F.lit(None).cast("double")
        return plain.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), (~blank).alias("keep"))
    levels = kneser_ney(counts, S.BYTES)
    scored = stage(score(plain.withColumn("blank", blank), levels, S.BYTES), "scores")
    rate = F.col("bits") / F.col("n_symbols")

    held = scored.join(trusted.where(fold("doc_id") == 0), "doc_id", "left_semi").where("not blank")
    band = F.floor(F.log2(F.greatest("n_symbols", F.lit(1))) / LENGTH_BITS).cast("int")
    held = held.select("lang", band.alias("band"), rate.alias("rate"))

    def limits(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        limit = F.percentile_approx("rate", 1.0 - FALSE_DROP, 10_000).alias(name)
        rows = rows.groupBy(*by).agg(limit, F.count(F.lit(1)).alias("n"))
        return rows.where(F.col("n") >= ENOUGH).select(*by, name)

    at = F.percentile_approx("rate", F.array(F.lit(MIDDLE), F.lit(HIGH), F.lit(1.0 - FALSE_DROP)), 10_000)
    q, n = held.agg(at, F.count(F.lit(1))).first()
    every = None if not n else q[2] if n >= ENOUGH else q[0] + REACH * (q[1] - q[0])
    judged = scored.withColumn("band", band).join(limits(held, ["lang"], "own"), "lang", "left")
    judged = judged.join(limits(held, ["lang", "band"], "near"), ["lang", "band"], "left")
    slack = SLACK_BITS / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    judged = judged.withColumn("limit", F.coalesce("near", F.coalesce("own", F.lit(every).cast("double")) + slack))
    over = rate > F.col("limit")
    return judged.select(
        "doc_id",
        "lang",
        F.pow(F.lit(2.0), rate).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("limit")).alias("threshold"),
        (~F.col("blank") & ~F.coalesce(over, F.lit(False))).alias("keep"),
    )
