"""Gradient boosting of trees on histograms, for all classes at once, as an estimator for pipelines of pyspark.ml."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.shared import shared_folder

#: Bins of a feature at most, so that a bin's number is one byte. Levels of a tree and leaves at most; rows of a leaf and sum of
#: its second derivatives at least; the step: settings of the boosted candidate.
BINS, DEPTH, LEAVES, LEAF_ROWS, LEAF_WEIGHT, STEP = 255, 5, 31, 20, 1e-3, 0.1
#: Rows in a block of arrays, and blocks of features whose histograms are summed up apart from each other.
BLOCK, FEATURES = 32_768, 32
#: Bytes of rows (bins and margins) in a partition; so many partitions' rows at most are held by a task for each class.
PART, ONE = 64 << 20, 2
#: Rows whose quantiles are the ends of bins.
SAMPLE = 200_000
#: States after which one is written and its lineage ends; rows from which margins become a new state in each round.
WRITTEN, FEW = 25, 300_000


class Tree(NamedTuple):
    """Nodes by number: the feature and the last bin that goes left, and the left child, whose neighbour is the right one; 0 for
    leaves. value: what a leaf adds to the class's margin; gain: what a split gained."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        if len(self.left) < 256 and x.flags.f_contiguous:
            # node by node, parents first: comparisons of whole columns cost less than looking up each row's own
            at = np.zeros(len(x), np.uint8)
            for node in np.flatnonzero(self.left).tolist():
                right = (x[:, self.feature[node]] > self.bin[node]).view(np.uint8)
                at += (at == node).view(np.uint8) * (right + np.uint8(self.left[node] - node))
            return at
        at = np.zeros(len(x), np.int64)
        while True:
            left = self.left[at]
            if not left.any():
                return at
            right = x[np.arange(len(x)), self.feature[at]] > self.bin[at]
            at = np.where(left > 0, left + right, at)


def edges_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The upper ends of bins: between values while there are few of them, else their quantiles."""
    own = np.unique(values)
    if len(own) <= bins:
        return (own[1:] + own[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """x <= edge goes to the bin of that edge."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1).astype(np.uint8)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slopes(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by the margins."""
    p = softmax(margins)
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1
    return p - hit, p * (1 - p)


def histogram(x, g, h, leaves, open_nodes, bins: int, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of (g, h, rows) by open node, feature and bin: 3 x nodes x features x bins, for one class. Rows in other nodes do not
    count. out: sums of other rows, which these are added to."""
    place = np.full(max(int(leaves.max(initial=0)), max(open_nodes)) + 1, -1)
    place[open_nodes] = np.arange(len(open_nodes))
    node = place[leaves]
    own = np.flatnonzero(node >= 0)
    every = len(own) == len(x)
    first, g, h = (node * bins, g, h) if every else (node[own] * bins, g[own], h[own])
    if out is None:
        out = np.zeros((3, len(open_nodes), x.shape[1], bins))
    for f in range(x.shape[1]):
        cells = first + (x[:, f] if every else x[:, f][own])
        for s, v in enumerate((g, h, None)):
            out[s, :, f] += np.bincount(cells, v, len(open_nodes) * bins).reshape(-1, bins)
    return out


def best_splits(sums: np.ndarray, first: int = 0) -> list[tuple]:
    """For each node of a histogram: gain, feature (numbered from first), bin, and (g, h, rows) on the left and in all; of equal
    gains the first feature and bin. Gain -inf where no split leaves both sides enough."""
    bins = sums.shape[3]
    left = sums.cumsum(3)
    total = left[:, :, 0, -1]
    room = (left[2] >= LEAF_ROWS) & (left[2] <= (total[2] - LEAF_ROWS)[:, None, None])
    at = np.flatnonzero(room)
    node = at // (sums.shape[2] * bins)
    g, h = (left[k].ravel()[at] for k in (0, 1))
    tg, th = total[0][node], total[1][node]
    fine = (h >= LEAF_WEIGHT) & (th - h >= LEAF_WEIGHT)
    gain = np.full(room.size, -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain[at] = np.where(fine, g * g / h + (tg - g) ** 2 / (th - h) - tg * tg / th, -np.inf)
    flat = gain.reshape(len(room), -1)
    out = []
    for k, cell in enumerate(flat.argmax(1).tolist()):
        f, b = divmod(cell, bins)
        out.append((float(flat[k, cell]), first + f, b, left[:, k, f, b].tolist(), total[:, k].tolist()))
    return out


class _Growing:
    """A class's tree of one round while it grows: nodes that may still be split, with their sums."""

    def __init__(self):
        self.feature, self.bin, self.left, self.sums, self.gain = [0], [0], [0], [None], [0.0]
        self.open = [0]

    def tree(self) -> Tree:
        value = [0.0 if s is None else -STEP * s[0] / max(s[1], 1e-12) for s in self.sums]
        return Tree(*(np.array(v, np.int64) for v in (self.feature, self.bin, self.left)), np.array(value), np.array(self.gain))

    def split(self, found: list[tuple], last: bool) -> None:
        """Splits the open nodes where that gains, the best first while there is room for leaves; their children are open."""
        room = LEAVES - (1 + sum(1 for x in self.left if x))
        order = sorted(range(len(found)), key=lambda i: (-found[i][0], i))
        nodes, self.open = self.open, []
        for i in order:
            gain, feature, edge, own, total = found[i]
            node = nodes[i]
            if self.sums[node] is None:
                self.sums[node] = total
            if gain <= 1e-10 or room <= 0:
                continue
            room -= 1
            self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, edge, len(self.left), gain
            for s in (own, [t - o for t, o in zip(total, own)]):
                if not last and s[2] >= 2 * LEAF_ROWS:
                    self.open.append(len(self.left))
                for column, v in ((self.feature, 0), (self.bin, 0), (self.left, 0), (self.sums, s), (self.gain, 0.0)):
                    column.append(v)
        self.open.sort()


def _blocks(rows, classes: list, edges: list[np.ndarray], start: np.ndarray):
    """Blocks of (bins, classes, margins) from rows of (features, label)."""
    numbers = {c: k for k, c in enumerate(classes)}
    x, y = [], []

    def block():
        b = np.asfortranarray(binned(np.array(x), edges))  # a feature's bins lie together
        return b, np.array(y), np.asfortranarray(np.tile(start, (len(y), 1)))

    for features, label in rows:
        x.append(features)
        y.append(numbers[label])
        if len(x) == BLOCK:
            yield block()
            x, y = [], []
    if x:
        yield block()


def _sums(blocks, trees: list[Tree], opens: list[list[int]], bins: int, width: int) -> dict:
    """Histograms of the blocks, by class and first of width features, for the open nodes of each class."""
    total: dict = {}
    for x, y, m in blocks:
        g, h = slopes(m, y)
        for k, nodes in enumerate(opens):
            if nodes:
                at = trees[k].leaf_of(x)
                for f in range(0, x.shape[1], width):
                    new = histogram(x[:, f : f + width], g[:, k], h[:, k], at, nodes, bins)
                    total[k, f] = new if (k, f) not in total else total[k, f] + new
    return total


def _added(state, trees: list[Tree], opens: list[list[int]], bins: int) -> list[tuple]:
    """The best splits by class and block of features from one pass over state. Each partition adds up its blocks; sums of
    the same features meet in one task, which adds them in the order of their partitions, so that the result does not
    depend on which came first, and passes on the best split of each node alone."""
    parts = state.mapPartitionsWithIndex(lambda i, b: [(key, (i, s)) for key, s in _sums(b, trees, opens, bins, FEATURES).items()])
    whole = parts.groupByKey().mapValues(lambda v: sum(s for _, s in sorted(v, key=lambda x: x[0])))
    return whole.map(lambda x: (x[0], best_splits(x[1], x[0][1]))).collect()


def _own_slopes(margins: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """slopes() of one class."""
    e = np.exp(margins - margins.max(1)[:, None])
    p = e[:, k] / e.sum(1)
    return p - (y == k), p * (1 - p)


def _own_tree(blocks: list, k: int, bins: int) -> Tree:
    """The tree of class k in one round, from blocks of all rows. Of two children the rows of the smaller one are added up; the
    other's sums are what that leaves of their parent's."""
    own = [(x, *_own_slopes(m, y, k)) for x, y, m in blocks]
    held: dict[int, np.ndarray] = {}

    def splits(trees: list[Tree], opens: list[list[int]]) -> list[tuple]:
        (tree,), (nodes,) = trees, opens
        pairs = [(p, int(left)) for p, left in enumerate(tree.left) if left and p in held and {left, left + 1} & set(nodes)]
        less = {left: left + int(2 * held[p][2, 0, tree.feature[p], : tree.bin[p] + 1].sum() > held[p][2, 0, 0].sum()) for p, left in pairs}
        # a node that may not be split needs no sums, unless they are those of the larger one
        wanted = sorted(less.values()) or nodes
        sums = None
        for x, g, h in own:
            sums = histogram(x, g, h, tree.leaf_of(x), wanted, bins, sums)
        new = {n: sums[:, i : i + 1] for i, n in enumerate(wanted)}
        for p, left in pairs:
            rest = held.pop(p) - new[less[left]]
            # bins without rows hold exactly 0
            rest[:2, rest[2] == 0] = 0
            new[2 * left + 1 - less[left]] = rest
        held.update({n: v for n, v in new.items() if n in nodes})
        return [((0, 0), [best_splits(held[n])[0] for n in nodes])]

    return _round(1, splits)[0]


def _round(classes: int, splits_of) -> list[Tree]:
    """A tree for each class, grown level by level. splits_of: from the trees so far and their open nodes to the best splits
    by class and block of features."""
    growing = [_Growing() for _ in range(classes)]
    for level in range(DEPTH):
        opens = [t.open for t in growing]
        if not any(opens):
            break
        best: dict[int, list] = {}
        for (k, _), some in sorted(splits_of([t.tree() for t in growing], opens), key=lambda x: x[0]):
            best[k] = some if k not in best else [a if a[0] >= b[0] else b for a, b in zip(best[k], some)]
        for k, splits in best.items():
            growing[k].split(splits, level == DEPTH - 1)
    return [t.tree() for t in growing]


def _moved(block, *added: list[Tree]):
    """The block with the trees of so many rounds added to its margins."""
    x, y, m = block
    m = m.copy("K")
    for trees in added:
        for k, t in enumerate(trees):
            m[:, k] += t.value[t.leaf_of(x)]
    return x, y, m


def feature_edges(flat: DataFrame, total: int, bins: int = BINS, sample: int = SAMPLE) -> list[np.ndarray]:
    """The ends of each feature's bins, from flat (x, y) of total rows: of all or, beyond sample rows, of about so many chosen by
    hash."""
    chosen = flat if total <= sample else flat.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)) < (sample << 20) // total)

    def columns(rows):
        own = np.array([r["x"] for r in rows])
        return [(f, own[:, f].copy()) for f in range(own.shape[1])] if len(own) else []

    edges = [np.zeros(0)] * len(flat.first()["x"])
    for f, own in chosen.select("x").rdd.mapPartitions(columns).groupByKey().mapValues(lambda v: edges_of(np.concatenate(list(v)), bins)).collect():
        edges[f] = own
    return edges


def boost(rows: DataFrame, features: str, label: str, rounds: int = 200, sample: int = SAMPLE):
    """(classes, edges, start, trees by round and class) from rows with a vector and a label.

    Features are cut into bins at quantiles, of all rows or, beyond sample rows, of about so many chosen by hash. Each round
    grows a tree for every class on the derivatives of the softmax loss, level by level: one pass over the rows adds up
    histograms for all classes at once, and the driver gets the best split of each node. What a task holds is a block of
    rows and the histograms of the open nodes; rows are never gathered. The margins are the state: each round adds its
    trees to them, and every WRITTEN states they are written to the shared folder, so lost executors cost that many
    at most. Bins and sums, and so the trees, do not depend on the order of partitions.

    Rows of ONE partitions at most are copied to a task for each class, which grows its class's tree of a round by itself, with
    the same result and one job for each round."""
    spark = rows.sparkSession
    flat = rows.select(vector_to_array(features).alias("x"), F.col(label).alias("y")).where("y is not null")
    counts = sorted((r["y"], r["n"]) for r in flat.groupBy("y").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        raise ValueError("no rows to train on")
    edges = feature_edges(flat, total, sample=sample)
    width, bins = len(edges), max(len(e) for e in edges) + 1
    classes = [c for c, _ in counts]
    start = np.log(np.array([n for _, n in counts]) / total)
    taken = total * (width + 8 * len(classes))
    parts = 1 if taken <= ONE * PART else -(-taken // PART)
    made = flat.repartition(parts, "x") if parts > 1 else flat.coalesce(1)
    state = made.sortWithinPartitions("y", "x").rdd.map(lambda r: (r["x"], r["y"])).mapPartitions(lambda it: _blocks(it, classes, edges, start))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if parts == 1:
        state = state.flatMap(lambda b: [(k, b) for k in range(len(classes))]).partitionBy(len(classes), lambda k: k).values()
    # trees are added to the margins after every so many rounds, which for few rows costs less than a state for each round
    often = max(1, math.isqrt(FEW // total)) if parts == 1 else 1
    state, before, every, new = state.persist(StorageLevel.MEMORY_AND_DISK), None, [], []
    for k in range(rounds):
        if parts == 1:
            every.append(state.mapPartitionsWithIndex(lambda c, b, add=tuple(new): [_own_tree([_moved(x, *add) for x in b], c, bins)]).collect())
        else:
            every.append(_round(len(classes), lambda t, o, now=state: _added(now, t, o, bins)))
        # the first job on a state has made it
        if before is not None:
            before.unpersist()
            before = None
        new.append(every[-1])
        if len(new) == often:
            before, state, new = state, state.map(lambda b, add=tuple(new): _moved(b, *add)).persist(StorageLevel.MEMORY_AND_DISK), []
            if (k + 1) // often % WRITTEN == 0:
                state.checkpoint()
    for last in (before, state):
        if last is not None:
            last.unpersist()
    return classes, edges, start, every


class _Stored(MLWriter):
    """A model's classes and margins at the start with its metadata; a row for each feature's edges and for each tree."""

    def __init__(self, model: BoostedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        said = {"classes": [int(c) for c in m.classes], "start": [float(v) for v in m.start], "features": m.features}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata=said)
        spark.createDataFrame([(f, e.tolist()) for f, e in enumerate(m.edges)], "feature int, edges array<double>").write.parquet(f"{path}/edges")
        trees = [(r, c, *(x.tolist() for x in t)) for r, every in enumerate(m.trees) for c, t in enumerate(every)]
        spark.createDataFrame(trees, "round int, class int, feature array<long>, bin array<long>, left array<long>, value array<double>, gain array<double>").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedModel:
        spark = self.sparkSession
        said = DefaultParamsReader.loadMetadata(path, spark)
        edges = [np.array(r.edges, float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        trees: list[list[Tree]] = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect():
            if r["class"] == 0:
                trees.append([])
            trees[-1].append(Tree(*(np.array(r[n], np.int64) for n in ("feature", "bin", "left")), *(np.array(r[n], float) for n in ("value", "gain"))))
        out = BoostedModel(said["classes"], edges, np.array(said["start"]), trees, said["features"])
        out._resetUid(said["uid"])
        return out


class BoostedModel(Model, MLWritable, MLReadable):
    """Adds probability (an array, in the order of classes) and prediction. Saved and loaded with the pipeline it is in."""

    def __init__(self, classes, edges, start, trees, features: str = "features"):
        super().__init__()
        self.classes, self.edges, self.start, self.trees, self.features = classes, edges, start, trees, features

    def write(self) -> MLWriter:
        return _Stored(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @property
    def featureImportances(self):
        """Each feature's share of what all splits gained."""
        out = np.zeros(len(self.edges))
        for trees in self.trees:
            for t in trees:
                np.add.at(out, t.feature, t.gain)
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = np.asfortranarray(binned(x, self.edges))
        out = np.tile(self.start, (len(x), 1))
        for trees in self.trees:
            out += np.stack([t.value[t.leaf_of(b)] for t in trees], 1)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast((self.edges, self.start, self.trees))
        classes, features = self.classes, self.features

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            own = BoostedModel(classes, *held.value)
            return pd.Series(list(softmax(own.margins(np.stack(x))))) if len(x) else pd.Series([], dtype=object)

        out = dataset.withColumn("probability", probability(vector_to_array(features)))
        top = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, classes)), top.cast("int")).cast("double"))


class HistogramBoosting(Estimator):
    """boost() as a pipeline's stage."""

    def __init__(self, rounds: int = 200, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.rounds, self.features, self.label = rounds, featuresCol, labelCol

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        return BoostedModel(*boost(dataset, self.features, self.label, self.rounds), features=self.features)
