"""Token ids of a corpus in files of patched blocks, in document order, and their reader.

Documents are range-partitioned by id and sorted inside partitions; each task tokenizes its
range and writes segments of whole documents (about ``SEGMENT_IDS`` ids; a longer document is a
segment of its own). The files are Parquet, so that Spark's committer writes them to any store
and a task that is run again replaces its own output; a segment's bytes are ``blocks``' format.
A row knows its shard (partition) and the ids before it there; the shards' totals, one row per
task, give the place in the whole corpus.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm import blocks
from ebbline.llm.sharing import kept_in_worker, tidied

SEGMENT_IDS = 1 << 18
# Pieces whose ids a worker remembers: those between spaces or line ends, and the words and runs of
# marks that they are put together from. Longer ones are not kept.
REMEMBERED, REMEMBERED_PARTS = 300_000, 1_000_000
LONGEST_REMEMBERED = 48
# Pieces handed to the tokenizer together.
TOGETHER = 4096
# Characters of whole texts whose new pieces are learnt together.
RUN_CHARS = 1 << 22
# Marks that may follow a run of letters.
_MARKS = ".,;:!?#$%&*|"
_LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")

_SEGMENTS = "shard int, seq bigint, before bigint, doc_ids array<bigint>, lengths array<bigint>, segment binary"


class PieceEncoder:
    """Ids of texts, each distinct piece encoded once by the tokenizer and remembered.

    For tokenizers that lower-case, drop white space and part a run of letters from the marks
    after it: then a piece's ids don't depend on the pieces around it. ``tests/llm`` compares it
    with whole texts. A text that holds an added token in any case is encoded whole. A full memory takes no more; what is not in it is encoded each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Tokens found in the text as it stands, by case; a piece has lost its case.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = sorted({t.content.encode().lower().decode() for t in added if t.content})
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}

    def _encoded_words(self, words: list[str]):
        """Ids of words of letters, which are one pre-token each: encoded as one text, parted by word number."""
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            cuts = np.flatnonzero(np.diff(np.array(found.word_ids), prepend=-1, append=len(some))) * 4
            if len(cuts) != len(some) + 1:
                raise ValueError("the tokenizer parts or joins words of letters")
            cuts = cuts.tolist()
            yield from ((x, ids[a:b]) for x, a, b in zip(some, cuts, cuts[1:]))

    def _encoded_others(self, others: list[str]):
        for i in range(0, len(others), TOGETHER):
            some = others[i : i + TOGETHER]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            yield from ((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(some, found))

    def _learn(self, missing) -> dict[str, bytes]:
        """Ids of pieces, by their parts: a word of letters and marks after it, or else the whole."""
        words, others = self.words, self.others
        out: dict[str, bytes] = {}
        rest: list[tuple[str, str, str]] = []
        for p in missing:
            if p in words:
                out[p] = words[p]
                continue
            word = p.rstrip(_MARKS)
            marks = p[len(word) :]
            if word in words and marks in others:
                out[p] = words[word] + others[marks]
            elif word in words or _LETTERS.fullmatch(word):
                rest.append((p, word, marks))
            elif p in others:
                out[p] = others[p]
            else:
                rest.append((p, "", p))
        new_words = dict(self._encoded_words(list({w for _, w, _ in rest if w and w not in words})))
        new_others = dict(self._encoded_others(list({o for _, _, o in rest if o not in others})))
        for p, word, other in rest:
            first = b"" if not word else words[word] if word in words else new_words[word]
            out[p] = first + (others[other] if other in others else new_others[other])
        for known, fresh in ((words, new_words), (others, new_others)):
            for x, ids in fresh.items():
                if len(words) + len(others) < REMEMBERED_PARTS and len(x) <= LONGEST_REMEMBERED:
                    known[x] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # The bytes' lower() changes A-Z alone.
        lowered = [text.lower() if text.isascii() else text.encode().lower().decode() for text in texts]
        whole = [i for i, text in enumerate(lowered) if any(a in text for a in self.added)]
        for i in whole:
            lowered[i] = ""
        parted = [text.replace("\n", " ").split(" ") for text in lowered]
        known = self.pieces
        missing = set().union(*parted).difference(known)
        ids = known if not missing else known | (learned := self._learn(missing))
        out = [b"".join([ids[p] for p in pieces]) for pieces in parted]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        if missing:
            for p, one in learned.items():
                if len(known) >= REMEMBERED:
                    break
                if len(p) <= LONGEST_REMEMBERED:
                    known[p] = one
        return out


def _runs(texts: list[str]):
    """Consecutive texts of about ``RUN_CHARS`` in all."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= RUN_CHARS:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write the ids of all texts under ``path``, in ascending id order.

    ``tokenizer`` names a tokenizer file that every executor can read. Each document ends with
    ``end_id``. A null text is empty (its end id alone); rows with equal ids follow each other in
    text order; null ids come first; other columns are not looked at. An empty table writes no
    segment.
    """
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches):
        encoder = kept_in_worker(f"encoder {tokenizer}", lambda: PieceEncoder(tokenizer))
        shard = TaskContext.get().partitionId()
        seq = before = size = 0
        ids, lengths, pieces = [], [], []

        def row():
            joined = np.frombuffer(b"".join(pieces), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([seq], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([blocks.encode(joined)], pa.binary()),
                ],
                ["shard", "seq", "before", "doc_ids", "lengths", "segment"],
            )

        for batch in batches:
            docs = batch.column(0).to_pylist()
            found_all = (x for run in _runs(batch.column(1).to_pylist()) for x in encoder.encode(run))
            for i, found in zip(docs, found_all):
                found += end
                if ids and size + len(found) // 4 > SEGMENT_IDS:
                    yield row()
                    seq, before, size = seq + 1, before + size, 0
                    ids, lengths, pieces = [], [], []
                ids.append(i)
                lengths.append(len(found) // 4)
                pieces.append(found)
                size += len(found) // 4
        if ids:
            yield row()

    ordered.mapInArrow(tidied(segments), _SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian u32 bytes), ``ids_crc32``."""
    stored = spark.read.schema(_SEGMENTS).parquet(path)
    totals = stored.select("shard", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))
    totals = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that wrote.
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def documents(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for shard, before, ids, lengths, segment in zip(*columns):
                values = blocks.decode(segment.as_py()).astype("<u4")
                lengths = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                parts = [values[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * len(parts), pa.int32()),
                        ids.values,
                        pa.array(before.as_py() + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(parts, pa.binary()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    ],
                    ["shard", "doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    rows = stored.select("shard", "before", "doc_ids", "lengths", "segment").mapInArrow(
        tidied(documents), "shard int, doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint"
    )
    placed = rows.join(F.broadcast(offsets), "shard")
    return placed.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids", "ids_crc32")
