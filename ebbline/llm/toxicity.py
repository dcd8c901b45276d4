"""Toxicity by the nearest labelled examples under TF-IDF cosine, with evidence.

The examples are a bounded sample of labelled rows: up to ``EXAMPLES`` of either label, those
with the lowest hashes, weighted back to the labels' counts. Every word of an example is a term;
its document frequency is counted over all documents. A term weighs more the further its shares
of either label's examples lie apart, but none is left out. Examples with equal vectors are one
entry, with the weight of each label. An inverted index over the entries finds neighbours: what
stands in many entries is a matrix, the rest are lists; sums in single precision name those that
can be among the nearest, whose cosines are then computed in full, so the neighbours are exact.
Votes weigh by a power of the cosine; a logistic curve, fitted to the examples' votes without
themselves, turns them into probabilities.
"""

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm import words as W
from ebbline.llm.decontaminate import Finder
from ebbline.llm.sharing import kept_in_worker, opened, share
from ebbline.sources.staging import stage

# The bound of the fit, per label.
EXAMPLES = 8192
# Deviations between the labels' shares at which a term has half of its weight, and those that
# any term is taken to have, so that none weighs nothing.
HALF_Z, LEAST_Z = 5.0, 0.5
NEIGHBOURS = 30
POWER = 4
PRIOR_WEIGHT = 0.5
# Terms held as a matrix over the entries, those of most entries; the other terms are lists.
COMMON = 256
# What sums of up to COMMON products in single precision can be off by, and more.
OFF = 1e-4
# Texts searched for together.
TOGETHER = 128
EVIDENCE = 3
SEED = 4
_REMEMBERED = 100_000


def _doc_words(column: pa.Array):
    """Word hashes of each text."""
    data, offsets = W.text_buffers(column)
    for first, last in W.runs(offsets):
        hashes, bounds = W.word_hashes(data, offsets[first : last + 1], W.LETTERED)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield hashes[a:b]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start .. start + size`` of each pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index:
    """Exact cosine search over unit-length rows of positive weights by their terms.

    Many queries are answered at once. Their cosines are first summed to within ``OFF``: by a
    matrix product over the common terms and the lists of the others; those that can be among
    the nearest are computed again from the rows.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = len(rows)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]).astype(np.int64)
        terms = np.concatenate([*[t for t, _ in rows], np.zeros(0, np.int64)]).astype(np.int64)
        self.weights = np.concatenate([*[w for _, w in rows], np.zeros(0)])
        self.terms, places, often = np.unique(terms, return_inverse=True, return_counts=True)
        self.places = places.astype(np.int32)
        self.common = np.sort(np.argsort(-often, kind="stable")[:COMMON])
        entry = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.bounds))
        column = np.full(len(self.terms), -1, np.int32)
        column[self.common] = np.arange(len(self.common))
        held = column[places] >= 0
        self.matrix = np.zeros((len(self.common), self.size), np.float32)
        self.matrix[column[places[held]], entry[held]] = self.weights[held]
        order = np.flatnonzero(~held)
        order = order[np.argsort(places[order], kind="stable")]
        self.listed, self.listed_weights = entry[order], self.weights[order].astype(np.float32)
        self.sizes = np.where(column < 0, often, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's ``k`` entries of greatest positive cosine, ties by place.

        Place of the query, of the entry, and the cosine (12 digits), nearest first.
        """
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms) or not queries:
            return nothing
        known = []
        for terms, weights in queries:
            place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            held = self.terms[place] == terms
            known.append((place[held], weights[held]))
        asked = np.zeros((len(queries), len(self.common)), np.float32)
        whole = np.zeros(len(self.terms))
        for i, (place, weights) in enumerate(known):
            whole[place] = weights
            asked[i] = whole[self.common]
            whole[place] = 0.0
        about = asked @ self.matrix
        found = [nothing]
        for i, (place, weights) in enumerate(known):
            sizes = self.sizes[place]
            at = _spans(self.starts[place], sizes)
            own = about[i] + np.bincount(self.listed[at], np.repeat(weights, sizes) * self.listed_weights[at], self.size)
            least = np.partition(own, -k)[-k] if self.size > k else 0.0
            near = np.flatnonzero((own >= least - 2 * OFF) & (own > 0))
            sizes = self.bounds[near + 1] - self.bounds[near]
            at = _spans(self.bounds[near], sizes)
            whole[place] = weights
            exact = np.bincount(np.repeat(np.arange(len(near)), sizes), whole[self.places[at]] * self.weights[at], len(near))
            whole[place] = 0.0
            exact = np.minimum(np.round(exact, 12), 1.0)
            order = np.lexsort((near, -exact))[:k]
            order = order[exact[order] > 0]
            found.append((np.full(len(order), i), near[order], exact[order]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _key(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Names a vector, in few bytes."""
    return hashlib.blake2b(places.tobytes() + b"|" + counts.tobytes(), digest_size=16).digest()


class Voter:
    """What scoring needs: terms, their weights, the index, votes of its entries, calibration."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples, weights: dict[int, float]):
        """``idf`` is each term's weight; ``examples`` are (doc, label, places, counts), in a fixed order."""
        self.terms, self.idf = terms, idf
        entries: dict[bytes, list] = {}
        blank = [0.0, 0.0]
        for doc, label, places, counts in examples:
            if not len(places):
                blank[label] += weights[label]
                continue
            entry = entries.setdefault(_key(places, counts), [places, counts, [0.0, 0.0], []])
            entry[2][label] += weights[label]
            entry[3].append(doc)
        keys = list(entries)
        self.place = {key: i for i, key in enumerate(keys)}
        self.rows = [entries[key][:2] for key in keys]
        self.index = Index([self.vector(*row) for row in self.rows])
        self.votes = np.array([entries[key][2] for key in keys]).reshape(-1, 2)
        self.evidence = [sorted(entries[key][3])[:EVIDENCE] for key in keys]
        self.weights = weights
        total = self.votes.sum(axis=0) + blank
        self.base = float((total[1] + 0.1) / (total.sum() + 1.0))
        self.blank = (blank[1] + self.base) / (sum(blank) + 1.0)
        self.slope, self.shift = 1.0, 0.0

    def __getstate__(self) -> dict:
        """Without the index, which is many times the size of the packed rows and soon made again."""
        places, counts = (np.concatenate([*x, np.zeros(0, np.int32)]).astype("<i4") for x in zip(*self.rows)) if self.rows else (np.zeros(0, "<i4"),) * 2
        # Steps between places by significance of their bytes, which pack best.
        packed = [zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in (np.diff(places, prepend=np.int32(0)), counts)]
        return self.__dict__ | {"index": None, "rows": ([len(p) for p, _ in self.rows], packed)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        sizes, packed = self.rows
        steps, counts = (np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1) for x in packed)
        cuts = np.cumsum(sizes)[:-1].astype(np.int64)
        parts = (np.split(x, cuts) if sizes else [] for x in (np.cumsum(steps).astype(np.int32), counts))
        self.rows = list(zip(*parts))
        self.index = Index([self.vector(*row) for row in self.rows])

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1.0 + np.log(counts)) * self.idf[places]
        return places, weight / np.sqrt((weight**2).sum())

    def vote(
        self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[tuple[bytes, int]] | None = None
    ) -> tuple[np.ndarray, list[list[int]]]:
        """Uncalibrated shares of toxic votes, and evidence, of (places, counts) pairs.

        ``without`` names, for each of them, an example to leave out.
        """
        shares, evidence = np.zeros(len(vectors)), []
        for first in range(0, len(vectors), TOGETHER):
            some = vectors[first : first + TOGETHER]
            query, found, cosine = self.index.search([self.vector(p, c) for p, c in some], NEIGHBOURS)
            votes = self.votes[found]
            if without is not None:
                own = without[first : first + TOGETHER]
                place = np.array([self.place[key] for key, _ in own])
                label = np.array([t for _, t in own])
                left = np.flatnonzero(found == place[query])
                votes[left, label[query[left]]] -= np.array([self.weights[0], self.weights[1]])[label[query[left]]]
            weight = cosine**POWER
            yes = np.bincount(query, weight * votes[:, 1], len(some))
            both = np.maximum(np.bincount(query, weight * votes.sum(axis=1), len(some)), 0.0)
            shares[first : first + len(some)] = np.maximum((yes + PRIOR_WEIGHT * self.base) / (both + PRIOR_WEIGHT), 0.0)
            starts = np.searchsorted(query, np.arange(len(some) + 1))
            for a, b in zip(starts[:-1], starts[1:]):
                evidence.append([d for i in found[a : min(b, a + EVIDENCE)] for d in self.evidence[i]][:EVIDENCE])
        return shares, evidence

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve over the votes' log odds, by Newton steps, weighted like the labels."""
        x = np.stack([_log_odds(shares), np.ones(len(shares))], axis=1)
        weight = np.array([self.weights[int(t)] for t in labels])
        weight = weight / max(weight.mean(), 1e-12) if len(weight) else weight
        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (labels - p)) - 1e-3 * (beta - [1.0, 0.0])
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            move = np.linalg.solve(curve, slope)
            beta = beta + np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-9:
                break
        self.slope, self.shift = max(float(beta[0]), 1e-6), float(beta[1])

    def score(self, share: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * _log_odds(share) + self.shift, -30, 30))))


def _log_odds(share):
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _terms(examples: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every term of the examples, and how its weight is scaled by what it tells of the label."""
    n = {t: float(max(sizes.get(t, 0), 1)) for t in (0, 1)}
    def rows(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            found = [np.unique(h) for h in _doc_words(batch.column("text"))]
            label = np.repeat(toxic, [len(f) for f in found])
            term = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(term, pa.int64())], ["toxic", "term"])

    held = examples.select("toxic", "text").mapInArrow(rows, "toxic int, term bigint").groupBy("term")
    # Bounded by the examples' words.
    held = held.agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).toArrow()
    term, yes, no = (held[c].to_numpy() for c in ("term", "yes", "no"))
    share = (yes + no + 1) / (n[0] + n[1] + 2)
    z = (yes / n[1] - no / n[0]) ** 2 / (share * (1 - share) * (1 / n[0] + 1 / n[1]))
    scale = (z + LEAST_Z**2) / (z + HALF_Z**2)
    term = term.astype(np.int64).view(np.uint64)
    order = np.argsort(term)
    return term[order], scale[order]


def _known(finder: Finder, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are terms, and their places."""
    at = finder.find(hashes)
    return at, np.searchsorted(finder.known, hashes[at]) if len(at) else at


def _frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Document frequency of each term over all texts, and the number of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def rows(batches):
        finder = Finder(shared.value)
        total, n = np.zeros(len(finder.known) + 1, np.int64), 0
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(0))
            for first, last in W.runs(offsets):
                hashes, bounds = W.word_hashes(data, offsets[first : last + 1], W.LETTERED)
                at, place = _known(finder, hashes)
                if len(at):
                    doc = np.searchsorted(bounds, at, "right") - 1
                    pairs = np.unique(doc * len(finder.known) + place)
                    np.add.at(total, pairs % len(finder.known), 1)
            n += len(batch)
        total[-1] = n
        seen = np.flatnonzero(total)
        for part in np.array_split(seen, len(seen) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["at", "c"])

    counted = texts.mapInArrow(rows, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[counted["at"].to_numpy()] = counted["c"].to_numpy()  # one row per term
    return out[:-1], int(out[-1])


def _vectors(column: pa.Array, finder: Finder):
    """Per text: places of its known terms and their counts, both ordered by place."""
    data, offsets = W.text_buffers(column)
    for first, last in W.runs(offsets):
        hashes, bounds = W.word_hashes(data, offsets[first : last + 1], W.LETTERED)
        at, place = _known(finder, hashes)
        width = max(len(finder.known), 1)
        doc = np.searchsorted(bounds, at, "right") - 1
        pairs, counts = np.unique(doc * width + place, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(last - first + 1) * width)
        place, counts = (pairs % width).astype(np.int32), counts.astype(np.int32)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield place[a:b], counts[a:b]


def _lists(column) -> list[np.ndarray]:
    """The rows of a column of lists of 32-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _voter(shared, name: str) -> Voter:
    """The shared voter ``name``, unpacked once a worker; an earlier one is let go."""
    held = kept_in_worker("voter", dict)
    if name not in held:
        held.clear()
        held[name] = opened(shared)
    return held[name]


def fit(docs: DataFrame, labels: DataFrame) -> Voter:
    """A voter from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = stage(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    chosen = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(EXAMPLES) for t in (0, 1)]
    # Bounded by twice EXAMPLES rows.
    sample = F.broadcast(stage(chosen[0].union(chosen[1]), "sample"))

    examples = stage(docs.join(sample, "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]), "examples")
    found = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    terms, scale = _terms(examples, found)
    frequency, n = _frequencies(docs.select("text"), terms)
    idf = (np.log((n + 1) / (frequency + 1)) + 1.0) * scale
    weights = {t: sizes.get(t, 0) / max(found.get(t, 0), 1) for t in (0, 1)}

    known = docs.sparkSession.sparkContext.broadcast(terms)
    kind = "doc_id bigint, toxic int, places array<int>, counts array<int>"

    def term_rows(batches):
        finder = Finder(known.value)
        for batch in batches:
            places, counts = zip(*_vectors(batch.column("text"), finder)) if len(batch) else ((), ())
            kept = [pa.array(x, pa.list_(pa.int32())) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *kept], ["doc_id", "toxic", "places", "counts"])

    held = stage(examples.select("doc_id", "toxic", "text").mapInArrow(term_rows, kind), "vectors")
    rows = held.toArrow()
    rows = zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), _lists(rows["places"]), _lists(rows["counts"]))
    voter = Voter(terms, idf, sorted(rows, key=lambda r: r[:2]), weights)
    if not len(voter.place):
        return voter
    shared, name = share(docs.sparkSession, voter), uuid.uuid4().hex

    def own_votes(batches):
        voter = _voter(shared, name)
        for batch in batches:
            vectors = list(zip(_lists(batch.column(2)), _lists(batch.column(3))))
            held = [i for i, (places, _) in enumerate(vectors) if len(places)]
            labels = batch.column(1).to_pylist()
            out = np.full(len(batch), voter.blank)
            out[held] = voter.vote([vectors[i] for i in held], [(_key(*vectors[i]), labels[i]) for i in held])[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["doc_id", "toxic", "share"])

    shares = held.repartition(12).mapInArrow(own_votes, "doc_id bigint, toxic int, share double").toPandas().sort_values("doc_id")
    shared.destroy()
    known.destroy()
    voter.calibrate(shares["share"].to_numpy(), shares["toxic"].to_numpy())
    return voter


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``score``, ``predicted``, ``evidence`` (ids of near examples) for every row.

    ``labels`` (doc_id, toxic) are the rows to learn from; nothing but a text enters its score.
    A null or empty text, and one without a word of any example, scores like the examples without
    words and has no evidence. Rows that repeat an id are scored each by its own text; an id
    labelled twice counts as toxic if any label says so; without labels every score is a low
    prior. Other columns are not looked at; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    shared, name = share(docs.sparkSession, fit(plain, labels)), uuid.uuid4().hex

    def rows(batches):
        voter = _voter(shared, name)
        finder = Finder(voter.terms)
        nothing = (voter.score(voter.blank), [])
        known: dict[bytes, tuple] = {}
        for batch in batches:
            vectors = list(_vectors(batch.column("text"), finder))
            keys = [_key(places, counts) for places, counts in vectors]
            new = {key: v for key, v in zip(keys, vectors) if len(v[0]) and key not in known}
            if len(known) + len(new) > _REMEMBERED:
                known = {}
                new = {key: v for key, v in zip(keys, vectors) if len(v[0])}
            for key, share, near in zip(new, *voter.vote(list(new.values()))):
                known[key] = (voter.score(share), near)
            found = [known.get(key, nothing) for key in keys]
            scores, evidence = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "score", "predicted", "evidence"],
            )

    return plain.mapInArrow(rows, "doc_id bigint, score double, predicted int, evidence array<bigint>")


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
