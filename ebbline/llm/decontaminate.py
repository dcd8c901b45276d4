"""Benchmark items inside documents: rare n-gram seeds, then Smith-Waterman alignment.

Items are taken in blocks of ``ITEMS`` (a set that is known and small beside the documents), so
that what is broadcast is bounded. One pass counts in how many documents each n-gram of the
items occurs; an item's rarer n-grams are its seeds. A second pass finds seeds in the documents
and aligns the words around them with the item, many alignments at a time. Nothing is shuffled
but counts and results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm import words as W
from ebbline.llm.sharing import opened, share, tidied
from ebbline.sources.staging import stage

ITEMS = 20_000
WIDTH = 3
# The share of an item's n-grams that are seeds, rarest first, and the least number of them.
SEED_SHARE, LEAST_SEEDS = 0.67, 12
MATCH, MISMATCH, GAP = 1, -1, -1
THRESHOLD = 0.4
TOGETHER = 256
_FILTER_BITS = 22


class Items:
    """Words and n-grams of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = np.array(ids, np.int64)
        data, offsets = W.text_buffers(pa.array(texts, pa.string()))
        hashes, bounds = W.word_hashes(data, offsets, W.LETTERED)
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        grams = [W.gram_hashes(w, WIDTH) for w in self.words]
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])

    def known(self) -> np.ndarray:
        return np.unique(self.gram)

    def keep_seeds(self, frequency: np.ndarray) -> None:
        """Leave the rarer n-grams of each item; ``frequency`` is by ``known()``."""
        often = frequency[np.searchsorted(self.known(), self.gram)] if len(self.gram) else self.gram
        order = np.lexsort((self.at, often, self.item))
        starts = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        place = np.arange(len(order)) - starts[self.item[order]]
        sizes = np.bincount(self.item, minlength=len(self.ids))
        wanted = np.maximum(LEAST_SEEDS, np.ceil(SEED_SHARE * sizes))
        order = order[place < wanted[self.item[order]]]
        order = order[np.argsort(self.gram[order], kind="stable")]
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]


class Finder:
    """Which of many hashes are in a sorted set: a bit table first, then a search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[known >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[place] == hashes[at]]


def _gram_runs(column: pa.Array):
    """Per run of documents: first document, words, bounds, n-grams that stay inside a document."""
    data, offsets = W.text_buffers(column)
    for first, last in W.runs(offsets):
        hashes, bounds = W.word_hashes(data, offsets[first : last + 1], W.LETTERED)
        grams = W.gram_hashes(hashes, WIDTH)
        yield first, hashes, bounds, grams


def _inside(at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose n-gram lies in one document, and that document."""
    doc = np.searchsorted(bounds, at, "right") - 1
    good = at + WIDTH <= bounds[doc + 1]
    return at[good], doc[good]


def document_frequency(texts: DataFrame, known: np.ndarray) -> np.ndarray:
    """In how many texts each known n-gram occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def rows(batches):
        finder = Finder(shared.value)
        total = np.zeros(len(finder.known), np.int64)
        for batch in batches:
            for _, _, bounds, grams in _gram_runs(batch.column(0)):
                at, doc = _inside(finder.find(grams), bounds)
                pairs = np.unique(doc * len(total) + np.searchsorted(finder.known, grams[at])) if len(at) else at
                total += np.bincount(pairs % max(len(total), 1), minlength=len(total)) if len(pairs) else 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["at", "c"])

    counted = texts.mapInArrow(tidied(rows), "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c"))
    out = np.zeros(len(known), np.int64)
    found = counted.toPandas()  # at most one row per n-gram of the block
    shared.destroy()
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: score and the place it ends at."""
    n = len(items)
    rows, columns = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, rows), np.uint64), np.zeros((n, columns), np.uint64)
    filled_a, filled_b = np.zeros((n, rows), bool), np.zeros((n, columns), bool)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, : len(x)], filled_a[i, : len(x)] = x, True
        b[i, : len(y)], filled_b[i, : len(y)] = y, True
    ramp = -GAP * np.arange(columns, dtype=np.int32)
    before = np.zeros((n, columns + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        same = (a[:, i : i + 1] == b) & filled_a[:, i : i + 1] & filled_b
        now = np.maximum(before[:, :-1] + np.where(same, MATCH, MISMATCH), before[:, 1:] + GAP)
        now = np.maximum(now, 0)
        # Gaps along the row: the best start to the left, less the way from it.
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        before[:, 1:] = now
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        higher = value > best
        best[higher], end[higher] = value[higher], top[higher]
    return best, end


def _candidates(items: Items, grams: np.ndarray, bounds: np.ndarray, finder: Finder):
    """Windows to align: document, item, first and last word (of the run), without repeats."""
    at, doc = _inside(finder.find(grams), bounds)
    low = np.searchsorted(items.gram, grams[at], "left")
    high = np.searchsorted(items.gram, grams[at], "right")
    each = np.repeat(np.arange(len(at)), high - low)
    if not len(each):
        return []
    entry = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
    item, doc = items.item[entry], doc[each]
    start = at[each] - items.at[entry]
    order = np.lexsort((start, item, doc))
    item, doc, start = item[order], doc[order], start[order]
    size = np.array([len(w) for w in items.words])[item]
    slack = np.maximum(size // 2, WIDTH)
    new = np.ones(len(start), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    begin = np.maximum(start[first] - slack[first], bounds[doc[first]])
    finish = np.minimum(start[last] + size[first] + slack[first], bounds[doc[first] + 1])
    # A long chain of seeds is cut into overlapping windows, so that an alignment stays small.
    out = []
    for d, i, x, y, m in zip(doc[first], item[first], begin, finish, size[first]):
        step, width = 2 * int(m), 4 * int(m) + 2 * WIDTH
        places = range(int(x), max(int(y) - width, int(x)) + step, step) if y - x > width else [int(x)]
        out += [(int(d), int(i), p, min(p + width, int(y))) for p in places]
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``end_word``, ``n_words``: items found in documents.

    Words are runs of letters and digits, A-Z in lower case. ``score`` is the best alignment of
    the item inside the document over that of the item with itself (match 1, mismatch and gap
    -1); rows below ``threshold`` are left out. ``end_word`` is the document's word, counted from
    0, after which the alignment ends. Items of fewer than three words have no seeds and null or
    empty texts no words: neither is found. Rows that repeat a document or item are reported each
    once per (doc_id, item_id), with the best score; rows with a null id are not looked at.
    Empty tables give an empty result, other columns are not looked at.
    """
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    plain = plain.where("doc_id is not null and text is not null")
    listed = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed = listed.where("item_id is not null and text is not null")
    blocks = -(-listed.count() // ITEMS)
    found = None
    for block in range(max(blocks, 1)):
        chosen = listed if blocks <= 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = chosen.collect()  # one block of the benchmark
        part = _find(plain, Items([r["item_id"] for r in rows], [r["text"] for r in rows]), threshold)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("score", "end_word", "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _find(plain: DataFrame, items: Items, threshold: float) -> DataFrame:
    items.keep_seeds(document_frequency(plain.select("text"), items.known()))
    shared = share(plain.sparkSession, items)

    def rows(batches):
        items = opened(shared)
        finder = Finder(items.known())
        sizes = [len(w) for w in items.words]
        for batch in batches:
            ids = batch.column(0)
            out = []
            for first, hashes, bounds, grams in _gram_runs(batch.column(1)):
                wanted = sorted(_candidates(items, grams, bounds, finder), key=lambda c: (sizes[c[1]], c[3] - c[2]))
                for i in range(0, len(wanted), TOGETHER):
                    some = wanted[i : i + TOGETHER]
                    score, end = align([items.words[c[1]] for c in some], [hashes[c[2] : c[3]] for c in some])
                    for c, s, e in zip(some, score, end):
                        share = float(s) / (MATCH * sizes[c[1]])
                        if share >= threshold:
                            out.append((ids[first + c[0]].as_py(), int(items.ids[c[1]]), share, c[2] + int(e) - int(bounds[c[0]]), sizes[c[1]]))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "end_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    fields = "doc_id bigint, item_id bigint, score double, end_word bigint, n_words bigint"
    found = stage(plain.mapInArrow(tidied(rows), fields), "found")
    shared.destroy()
    return found
