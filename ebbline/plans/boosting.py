"""Spark's gradient-boosted trees over blocks of binned rows.

Spark's own fit runs some jobs for every level of every tree, and adds each value of each row to
its node by itself. Here the rows are binned once, in as many tasks as their files ask for, and
counted a block at a time. Rows that make one block are boosted where they are, in one job. More are
dealt to several; a job a level adds up what they count, and the driver chooses the splits.
"""

import json
import pickle
import sys
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ebbline.sources.staging import new_path

# What runs in tasks travels with them, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that make one block alone (some 100 bytes each while they are read, then 50), those of a block
# among others, and those that are counted at a time.
ALONE_ROWS = 1 << 22
BLOCK_ROWS = 1 << 19
BATCH = 1 << 17
# Rounds after which the rows' margins are made anew of all trees, which cuts their lineage.
REPLAYED = 50
# Blocks whose sums the driver adds itself.
BLOCKS_AT_ONCE = 64
# Features with few bins are counted together, as one code of at most so many values.
MAX_CODES = 1 << 10
# Bins of a feature, with which a code still is a number of 16 bits.
MAX_BINS = 1 << 16
# A gain below this share of the weights is rounding.
LEAST_GAIN = 1e-13

# How Spark saves the nodes of an ensemble.
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
    "rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


class BlockGBT(GBTClassifier):
    """Boosted trees of the same parameters, losses, bins, stops and order of splits as Spark's.

    Without drawing rows or columns the trees are those of ``GBTClassifier``, to within rounding and
    the choice between splits of equal gain; drawn rows and columns follow the same law from another
    generator. Fits with a validation column go to ``GBTClassifier``. ``alone_rows`` are the rows
    that one task holds: many fits at once take least time each in a task of its own, a single one
    in several.
    """

    alone_rows = None

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        if self.isDefined(self.validationIndicatorCol):
            return super()._fit(dataset)
        thresholds, meta = _bins(self, dataset)
        if max(map(len, thresholds)) >= MAX_BINS:
            return super()._fit(dataset)
        packing, law = Packing(thresholds), self._law(meta)
        given = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"),
            F.col(self.getLabelCol()).cast("double").alias("y"),
            (F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1)).cast("double").alias("w"),
        )
        binned = given.mapInArrow(packing.rows, ", ".join([*[f"c{g} int" for g in range(len(packing.groups))], "y double", "w double"]))
        path, kinds = new_path(dataset.sparkSession, "boosted"), to_arrow_schema(_parse_datatype_string(NODES))
        if meta["rows"] <= (self.alone_rows or ALONE_ROWS):
            nodes = binned.repartition(1).mapInArrow(_boosting(packing, law, kinds), NODES)
        else:
            trees = boost_over(binned.repartition(-(-meta["rows"] // BLOCK_ROWS)), packing, law)
            grown = pa.Table.from_batches([_batch(i, tree, kinds) for i, tree in enumerate(trees)])
            nodes = dataset.sparkSession.createDataFrame(grown, NODES)
        nodes.write.parquet(f"{path}/data")
        return self._copyValues(_load(dataset.sparkSession, path, self, meta["features"]))

    def _law(self, meta: dict) -> dict:
        return {
            "rounds": self.getMaxIter(),
            "depth": self.getMaxDepth(),
            "rate": self.getStepSize(),
            "share": self.getSubsamplingRate(),
            "features": meta["features"],
            "drawn": meta["drawn"],
            "least_rows": self.getMinInstancesPerNode(),
            "least_weight": meta["weight"] * self.getMinWeightFractionPerNode(),
            "least_gain": self.getMinInfoGain(),
            "seed": self.getSeed() & (1 << 64) - 1,
        }


def _bins(estimator: GBTClassifier, dataset: DataFrame) -> tuple[list[list[float]], dict]:
    """The bounds of each feature's bins, by Spark's own search, and what was counted for them."""
    estimator._transfer_params_to_java()
    jvm = SparkContext._active_spark_context._jvm
    spark = jvm.org.apache.spark

    def module(package, name: str):
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    instances = module(spark.ml.util, "DatasetUtils").extractInstances(estimator._java_obj, dataset._jdf, jvm.scala.Some(2))
    plain = module(jvm.scala.collection.immutable, "Map").empty()
    strategy = estimator._java_obj.getOldBoostingStrategy(plain, spark.mllib.tree.configuration.Algo.Classification())
    strategy = strategy.treeStrategy().copy()
    strategy.setAlgo("Regression")
    strategy.setImpurity(spark.mllib.tree.impurity.Variance.instance())
    metadata = spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, estimator.getFeatureSubsetStrategy())
    splits = module(spark.ml.tree.impl, "RandomForest").findSplits(instances, metadata, estimator.getSeed())
    meta = {
        "rows": metadata.numExamples(),
        "weight": metadata.weightedNumExamples(),
        "features": metadata.numFeatures(),
        "drawn": metadata.numFeaturesPerNode(),
    }
    return [[split.threshold() for split in feature] for feature in splits], meta


def _load(spark, path: str, estimator: GBTClassifier, features: int) -> GBTClassificationModel:
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": {"impurity": "variance"}, "defaultParamMap": {}}
    kind = "org.apache.spark.ml.{}"
    trees = []
    for i in range(estimator.getMaxIter()):
        own = {"class": kind.format("regression.DecisionTreeRegressionModel"), "uid": f"{estimator.uid}_{i}", **about}
        trees.append((i, json.dumps(own), estimator.getStepSize() if i else 1.0))
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {"class": kind.format("classification.GBTClassificationModel"), "uid": estimator.uid, **about}
    whole |= {"numFeatures": features, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


class Packing:
    """Bins of the features that have several, packed into few codes a row."""

    def __init__(self, thresholds: list[list[float]]):
        self.thresholds = [np.array(t) for t in thresholds]
        # A feature without bounds has one bin; one is kept if there are no others.
        self.split = [f for f, t in enumerate(thresholds) if t] or [0]
        self.bins = [len(thresholds[f]) + 1 for f in self.split]
        # Of each group: its features (as places in ``split``), and the number of its codes.
        self.groups, self.sizes = [], []
        for i in sorted(range(len(self.split)), key=lambda i: -self.bins[i]):
            for g, size in enumerate(self.sizes):
                if size * self.bins[i] <= MAX_CODES:
                    self.groups[g].append(i)
                    self.sizes[g] *= self.bins[i]
                    break
            else:
                self.groups.append([i])
                self.sizes.append(self.bins[i])
        # Of each feature: its group, and what a bin of it counts in the group's code.
        self.group, self.stride = [0] * len(self.split), [0] * len(self.split)
        for g, members in enumerate(self.groups):
            stride = self.sizes[g]
            for i in members:
                stride //= self.bins[i]
                self.group[i], self.stride[i] = g, stride
        self.starts = np.concatenate([[0], np.cumsum(self.bins)]).astype(int)
        # The place of each bin among those of all features, or an empty place behind them all.
        bins = np.arange(max(self.bins))
        many = np.array(self.bins)[:, None]
        self.places = np.where(bins < many, self.starts[:-1, None] + bins, self.starts[-1])
        self.cuts = bins < many - 1

    def rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.zeros((len(self.groups), batch.num_rows), np.int32)
            for f, g, stride in zip(self.split, self.group, self.stride, strict=True):
                codes[g] += np.searchsorted(self.thresholds[f], x[:, f]).astype(np.int32) * stride
            names = [*[f"c{g}" for g in range(len(codes))], "y", "w"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), batch.column(1), batch.column(2)], names)

    def bin_of(self, feature: int) -> np.ndarray:
        """The bin of a feature in each code of its group."""
        return np.arange(self.sizes[self.group[feature]]) // self.stride[feature] % self.bins[feature]

    def by_bin(self, counted: list[np.ndarray]) -> np.ndarray:
        """Sums by code of each group (last axis) to sums by bin, all features one after another."""
        out = np.empty((*counted[0].shape[:-1], self.starts[-1]))
        lead = out.ndim - 1
        for members, sums in zip(self.groups, counted, strict=True):
            sums = sums.reshape(*sums.shape[:-1], *[self.bins[i] for i in members])
            for axis, i in enumerate(members):
                others = tuple(lead + a for a in range(len(members)) if a != axis)
                out[..., self.starts[i] : self.starts[i + 1]] = sums.sum(axis=others)
        return out


def _batch(i: int, tree: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"treeID": i, "nodeData": node} for node in tree], kinds)


def _boosting(packing: Packing, law: dict, kinds: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, tree in enumerate(boost(Rows.read(batches, packing), packing, law)):
            yield _batch(i, tree, kinds)

    return run


class Rows:
    """Binned rows of one task, and where they stand in the boosting."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray | None = None):
        self.codes, self.y, self.w = codes, y, w
        self.margin = np.zeros(len(y)) if margin is None else margin.copy()

    @classmethod
    def read(cls, batches: Iterable[pa.RecordBatch], packing: Packing) -> "Rows":
        kept = [[] for _ in range(len(packing.groups) + 2)]
        for batch in batches:
            for g, column in enumerate(batch.columns):
                kept[g].append(column.to_numpy(zero_copy_only=False).astype(np.uint16 if g < len(packing.groups) else float))
        columns = [np.concatenate(v) if v else np.empty(0) for v in kept]
        # A shuffle hands over its rows in any order; those that are equal here may change places.
        order = np.lexsort(columns[::-1])
        codes = np.array([c[order] for c in columns[:-2]], np.uint16).reshape(len(packing.groups), -1)
        return cls(codes, (columns[-2][order] * 2 - 1).astype(np.int8), columns[-1][order])

    def begin(self, m: int, law: dict, part: int) -> None:
        # The first tree is fitted to the labels, the others to the gradient of the logistic loss.
        self.residual = 4.0 * self.y / (1.0 + np.exp(2.0 * self.y * self.margin)) if m else self.y.astype(float)
        self.weighted, self.taken = self.w * self.residual, None
        if law["share"] < 1:
            self.taken = np.random.default_rng([law["seed"], m, part]).random(len(self.y)) < law["share"]
        self.restart()

    def restart(self) -> None:
        self.at, self.passed = np.zeros(len(self.y), np.int32), 0

    def go(self, packing: Packing, steps: list[dict]) -> None:
        """On to the node of each row, by the steps that it hasn't taken yet."""
        flat, n = self.codes.reshape(-1), len(self.y)
        for step in steps[self.passed :]:
            group = np.array(packing.group)[step["feature"]] * n
            right = np.zeros((len(group), max(packing.sizes)), bool)
            for goes, i, cut in zip(right, step["feature"], step["cut"], strict=True):
                goes[: packing.sizes[packing.group[i]]] = packing.bin_of(i) > cut
            for a in range(0, n, BATCH):
                own = self.at[a : a + BATCH]
                slot = step["slot"][own]
                rows = np.flatnonzero(slot >= 0)
                slot = slot[rows]
                code = flat[group[slot] + (rows + a)]
                own[rows] = step["first"][slot] + right[slot, code]
        self.passed = len(steps)

    def count(self, packing: Packing, steps: list[dict], ids: list[int], n_nodes: int) -> np.ndarray:
        """Rows, weights and weighted residuals of each of these nodes and each bin."""
        self.go(packing, steps)
        slots = np.full(n_nodes, -1)
        slots[ids] = np.arange(len(ids))
        counted = [np.zeros((3, len(ids) * size)) for size in packing.sizes]
        for a in range(0, len(self.y), BATCH):
            b = slice(a, a + BATCH)
            own = slots[self.at[b]]
            rows = np.flatnonzero(own >= 0 if self.taken is None else (own >= 0) & self.taken[b])
            own, w, r = own[rows], self.w[b][rows], self.weighted[b][rows]
            for g, size in enumerate(packing.sizes):
                index = own * size + self.codes[g, b][rows]
                for sums, values in zip(counted[g], (None, w, r), strict=True):
                    sums += np.bincount(index, values, len(sums))
        return packing.by_bin([c.reshape(3, len(ids), -1) for c in counted])

    def end(self, packing: Packing, steps: list[dict], predictions: np.ndarray, rate: float) -> np.ndarray:
        """Add a finished tree; the weighted squares of what it was fitted to, by node."""
        self.add(packing, steps, predictions, rate)
        own = slice(None) if self.taken is None else self.taken
        return np.bincount(self.at[own], (self.weighted * self.residual)[own], len(predictions))

    def add(self, packing: Packing, steps: list[dict], predictions: np.ndarray, rate: float) -> None:
        self.go(packing, steps)
        self.margin += rate * predictions[self.at]


def boost(rows: Rows, packing: Packing, law: dict) -> Iterator[list[dict]]:
    """The trees of all rounds, each as its nodes."""
    for m in range(law["rounds"]):
        rows.begin(m, law, 0)
        nodes, steps = grow(lambda *asked: rows.count(packing, *asked), packing, law, m)
        yield saved(nodes, rows.end(packing, *added(nodes, steps, law, m)))


def added(nodes: list[dict], steps: list[dict], law: dict, m: int) -> tuple:
    """What adds a tree to the margins: its steps, predictions and weight."""
    return steps, np.array([node["prediction"] for node in nodes]), law["rate"] if m else 1.0


def boost_over(binned: DataFrame, packing: Packing, law: dict) -> list[list[dict]]:
    """Like ``boost``, each partition of ``binned`` being a block that its tasks pass on, round by round."""
    context = binned.sparkSession.sparkContext

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows.read(batches, packing)
        yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((rows.codes, rows.y, rows.w, rows.margin), 5)], pa.binary())})

    # A state is a block's rows with their margins, and the squares of the last tree.
    def unpack(part, row):
        return pickle.loads(row["block"]), None

    def count(part, state, m, *asked):
        rows = Rows(*state[0])
        rows.begin(m, law, part)
        return rows.count(packing, *asked), state[1]

    def pass_on(part, state, m, trees):
        rows = Rows(*state[0])
        for tree in trees[:-1]:
            rows.restart()
            rows.add(packing, *tree)
        rows.begin(m, law, part)
        squares = rows.end(packing, *trees[-1])
        return (rows.codes, rows.y, rows.w, rows.margin), squares

    # The code goes to the executors once, and not with each of the many jobs.
    kernel = context.broadcast(cloudpickle.dumps({f.__name__: f for f in (unpack, count, pass_on)}))

    def over(blocks, name: str, *given):
        def run(part, states):
            for state in states:
                yield pickle.loads(kernel.value)[name](part, state, *given)

        return blocks.mapPartitionsWithIndex(run)

    def total(found) -> tuple:
        if found.getNumPartitions() > BLOCKS_AT_ONCE:
            return found.treeReduce(lambda a, b: tuple(None if x is None else x + y for x, y in zip(a, b, strict=True)))
        return tuple(None if parts[0] is None else sum(parts) for parts in zip(*found.collect(), strict=True))

    first = over(binned.mapInArrow(pack, "block binary").rdd, "unpack")
    trees, added_trees, last = [], [], None
    state = first.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for m in range(law["rounds"]):
            found, squares = total(over(state, "count", m, [], [0], 1))
            if last:
                trees.append(saved(trees.pop(), squares))
                last.unpersist()
            asked = [found]
            nodes, steps = grow(lambda *ask: asked.pop() if asked else total(over(state, "count", m, *ask))[0], packing, law, m)
            trees.append(nodes)
            added_trees.append(added(nodes, steps, law, m))
            replayed = (m + 1) % REPLAYED == 0
            last, state = state, over(first if replayed else state, "pass_on", m, added_trees if replayed else added_trees[-1:])
            state.persist(StorageLevel.MEMORY_AND_DISK)
        squares = total(state.map(lambda passed: passed[1:]))[0]
        return [*trees[:-1], saved(trees[-1], squares)]
    finally:
        for kept in (last, state):
            if kept:
                kept.unpersist()
        kernel.destroy()


def grow(count: Callable, packing: Packing, law: dict, m: int) -> tuple[list[dict], list[dict]]:
    """One tree of what ``count(steps, ids, n_nodes)`` finds: its nodes, and a step to each level."""
    rng = np.random.default_rng([law["seed"], m])

    def node(rows, weight, value) -> dict:
        mean = float(value / weight) if weight > 0 else 0.0
        return {"rows": int(rows), "weight": float(weight), "sum": float(value), "prediction": mean, "left": -1, "right": -1, "gain": -1.0}

    steps, level = [], [0]
    found = count(steps, level, 1)
    nodes = [node(*found[:, 0, : packing.bins[0]].sum(axis=1))]
    least = LEAST_GAIN * nodes[0]["weight"]
    for depth in range(law["depth"]):
        left = np.cumsum(np.concatenate([found, np.zeros((3, len(level), 1))], axis=2)[:, :, packing.places], axis=3)
        whole = left[..., -1:]
        right = whole - left
        fits = packing.cuts & (np.minimum(left[0], right[0]) >= max(law["least_rows"], 1))
        fits &= np.minimum(left[1], right[1]) >= law["least_weight"]
        if law["drawn"] < law["features"]:
            drawn = rng.random((len(level), law["features"])).argsort(axis=1) < law["drawn"]
            fits &= drawn[:, packing.split, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - whole[2] ** 2 / whole[1]
        gains = np.where(fits, gains, -np.inf).reshape(len(level), -1)
        step = {"slot": np.full(len(nodes), -1), "first": [], "feature": [], "cut": []}
        pairs = []
        for k, me in enumerate(level):
            best = int(gains[k].argmax())
            gain, (i, cut) = float(gains[k, best]), divmod(best, fits.shape[2])
            own = nodes[me]
            if not gain > least or gain / own["weight"] < law["least_gain"]:
                continue
            f = packing.split[i]
            own |= {"gain": gain / own["weight"], "feature": f, "threshold": float(packing.thresholds[f][cut])}
            own |= {"left": len(nodes), "right": len(nodes) + 1}
            step["slot"][me] = len(pairs)
            step["first"].append(len(nodes))
            step["feature"].append(i)
            step["cut"].append(cut)
            nodes += [node(*left[:, k, i, cut]), node(*right[:, k, i, cut])]
            pairs.append((k, *sorted((own["left"], own["right"]), key=lambda c: nodes[c]["rows"])))
        if not pairs:
            break
        steps.append({name: np.array(values) for name, values in step.items()})
        if depth + 1 == law["depth"]:
            break
        # Only the smaller child of a pair is counted; the other is the rest of their parent.
        small = count(steps, [pair[1] for pair in pairs], len(nodes))
        rest = found[:, [pair[0] for pair in pairs]] - small
        rest[1:, rest[0] == 0] = 0.0
        level = [child for _, *both in pairs for child in both]
        found = np.stack([small, rest], axis=2).reshape(3, len(level), -1)
    return nodes, steps


def saved(nodes: list[dict], squares: np.ndarray) -> list[dict]:
    """The nodes as Spark saves them; ``squares`` are known of leaves."""
    squares = [float(x) for x in squares]
    for i, node in reversed([*enumerate(nodes)]):
        if node["left"] > 0:
            squares[i] = squares[node["left"]] + squares[node["right"]]
    return [
        {
            "id": i,
            "prediction": node["prediction"],
            "impurity": max(squares[i] / node["weight"] - node["prediction"] ** 2, 0.0) if node["weight"] > 0 else 0.0,
            "impurityStats": [node["weight"], node["sum"], squares[i]],
            "rawCount": node["rows"],
            "gain": node["gain"],
            "leftChild": node["left"],
            "rightChild": node["right"],
            "split": {
                "featureIndex": node.get("feature", -1),
                "leftCategoriesOrThreshold": [node["threshold"]] if "threshold" in node else [],
                "numCategories": -1,
            },
        }
        for i, node in enumerate(nodes)
    ]
