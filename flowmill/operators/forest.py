"""Random forests on binned features, as an estimator for pipelines of pyspark.ml: nodes of many rows are split on histograms that
all partitions add to, nodes of few rows are finished in the task that their rows are sent to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.shared import shared_folder
from flowmill.operators.boosting import binned, feature_edges

#: Bins of a feature at most, as MLlib's forest has them.
BINS = 32
#: Rows of a node that one task may hold, bytes of rows in a partition, and rows in a block of arrays; rows that are scored
#: with a tree at a time.
HELD, PART, BLOCK, SCORED = 1 << 19, 1 << 20, 8192, 1 << 17
#: Bytes of trees that the driver and each Python worker may hold; larger forests stay in the shared folder. A tree that is alone
#: is finished by so many tasks at least, if they get this many rows each.
KEPT, SHARED, OWN = 64 << 20, 64, 1 << 12
#: Bytes of a tree for each row that it may have to tell apart, and of trees that a task puts together, one after the other.
NODE, WRITTEN = 24, 16 << 20
#: Trees whose rows or histograms a partition makes at a time; tasks that finish nodes at most.
TREES, TASKS = 100, 2048
#: A split gains more than this share of its node's weight.
LEAST = 1e-12
#: Rows of a node, in the mean of a level, from which sums of all its cells cost less than sorted rows.
WIDE = 64


class Tree(NamedTuple):
    """Nodes by number: feature, last bin that goes left, left child (its neighbour is the right one; 0 for leaves), what the split
    took off the impurity, times the node's weight; first: where each node's own entries begin in (of, share), the classes
    in a leaf and their shares."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    first: np.ndarray
    of: np.ndarray
    share: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            now = at[rows]
            left = self.left[now]
            rows, now, left = (v[left > 0] for v in (rows, now, left))
            at[rows] = left + (x[rows, self.feature[now]] > self.bin[now])
        return at

    def shares(self, x: np.ndarray, classes: int) -> np.ndarray:
        leaf = self.leaf_of(x)
        n = self.first[leaf + 1] - self.first[leaf]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[leaf], n)
        return np.bincount(np.repeat(np.arange(len(x)), n) * classes + self.of[at], self.share[at], len(x) * classes).reshape(-1, classes)


#: Numbers of a stored tree's arrays.
KINDS = dict(zip(Tree._fields, ("<i4", "<i2", "<i4", "<f8", "<i4", "<i4", "<f8")))
#: A stored tree: each feature's importance, bytes of all arrays, and these in little-endian order.
STORED = "tree int, importance array<double>, bytes long, " + ", ".join(f"{n} binary" for n in KINDS)


class StoredTrees(Sequence):
    """A forest's trees as a table in a folder that all executors share, a tree to a row; whoever needs them reads one at a time."""

    def __init__(self, where: str, count: int):
        self.where, self.count = where.rstrip("/"), count

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(self.count))]
        if not -self.count <= i < self.count:
            raise IndexError(i)
        return next(self._read([i % self.count]))

    def __iter__(self) -> Iterator[Tree]:
        return self._read(range(self.count))

    def _read(self, wanted) -> Iterator[Tree]:
        from pyarrow import fs, parquet

        system, at = fs.FileSystem.from_uri(self.where.removeprefix("file://"))
        for i in wanted:
            for file in system.get_file_info(fs.FileSelector(f"{at}/tree={i}")):
                if file.path.endswith(".parquet"):
                    with system.open_input_file(file.path) as f:
                        row = parquet.ParquetFile(f).read(list(KINDS))
                    yield _held({n: row[n][0].as_buffer() for n in KINDS})


def _held(row) -> Tree:
    return Tree(*(np.frombuffer(row[n], kind) for n, kind in KINDS.items()))


def _stored(tree: Tree) -> tuple:
    return tuple(bytearray(np.ascontiguousarray(v, KINDS[n]).tobytes()) for n, v in zip(Tree._fields, tree))


def importance(tree: Tree, width: int) -> np.ndarray:
    """Each feature's share of what the tree's splits took off the impurity."""
    own = np.bincount(tree.feature, tree.gain, width)
    return own / own.sum() if own.sum() else own


def _kept(spark: SparkSession, where: str) -> tuple[Sequence, np.ndarray]:
    """The trees in a folder, and their importances by tree and feature: in memory if all take less than KEPT bytes."""
    table = spark.read.schema(STORED).parquet(where)
    told = sorted(table.select("tree", "importance", "bytes").collect())
    if sum(r["bytes"] for r in told) < KEPT:
        trees: Sequence = [_held(r) for r in sorted(table.collect(), key=lambda r: r["tree"])]
    else:
        trees = StoredTrees(where, len(told))
    return trees, np.array([r["importance"] for r in told])


def _tree(feature, edge, left, gain, total: np.ndarray) -> Tree:
    """total: the weight of each class in each node."""
    node, of = np.nonzero((total > 0) & (left == 0)[:, None])
    first = np.searchsorted(node, np.arange(len(left) + 1))
    small = np.int16 if total.shape[1] < 1 << 15 else np.int32
    return Tree(feature.astype(np.int32), edge.astype(np.int16), left.astype(np.int32), gain, first.astype(np.int32), of.astype(small), total[node, of] / total.sum(1)[node])


def _wide_gains(x, y, w, node, total: np.ndarray, size: np.ndarray, squares: np.ndarray):
    """(node, gain, bin) of each node's best split on one feature, from sums of all its cells."""
    m, k = total.shape
    sums = np.bincount((node * BINS + x) * k + y, w, m * BINS * k).reshape(m, BINS, k)
    last = BINS - 1 - (sums.any(2)[:, ::-1]).argmax(1)
    low = sums.cumsum(1)
    a, own, with_all = low.sum(2), np.einsum("nbk,nbk->nb", low, low), np.einsum("nbk,nk->nb", low, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = own / a + (squares[:, None] - 2 * with_all + own) / (size[:, None] - a) - (squares / size)[:, None]
    g[(a <= 0) | (np.arange(BINS) >= last[:, None])] = -np.inf
    best = g.argmax(1)
    return np.arange(m), g[np.arange(m), best], best


def _narrow_gains(x, y, w, node, size: np.ndarray, squares: np.ndarray, start: np.ndarray, kinds: np.ndarray, groups: np.ndarray, met: np.ndarray):
    """The same from sorted rows, for nodes of few rows. start: where each node's rows begin; kinds: node and class of each row, groups:
    where rows of each of these begin once sorted, met: the weight of the row's class in its node, times its own."""
    cells = (node * BINS + x).astype(np.uint16)
    order = np.argsort(cells, kind="stable")
    cells, w, met = cells[order], w[order], met[order]
    by_class = np.argsort(kinds[order], kind="stable")
    own = w[by_class]
    before = own.cumsum() - own
    before -= np.repeat(before[groups[:-1]], np.diff(groups))
    grown = np.empty(len(w))
    grown[by_class] = own * (2 * before + own)
    at = np.flatnonzero(cells[1:] != cells[:-1])
    of = cells[at] // BINS
    at, of = (v[cells[at + 1] // BINS == of] for v in (at, of))
    if not len(at):
        return of, np.zeros(0), of
    a, own, with_all = (v[at + 1] - v[start[of]] for v in (np.concatenate([[0.0], c.cumsum()]) for c in (w, grown, met)))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = own / a + (squares[of] - 2 * with_all + own) / (size[of] - a) - squares[of] / size[of]
    here = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    peak = np.maximum.reduceat(g, here)
    hit = np.flatnonzero(g == np.repeat(peak, np.diff(np.append(here, len(of)))))
    place = hit[np.searchsorted(hit, here)]
    return of[here], peak, cells[at[place]] % BINS


def best_splits(x, y, w, node, total: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gain, feature and bin of each node's best split by Gini impurity; gain 0 where none gains. node: the node of each row,
    total: weight by node and class, chosen: the features that each node may use."""
    if (node[1:] < node[:-1]).any():
        order = np.argsort(node, kind="stable")
        x, y, w, node = x[order], y[order], w[order], node[order]
    return _sorted_splits(np.ascontiguousarray(x), np.arange(len(y)), y, w, node, total, chosen)


def _sorted_splits(x, rows, y, w, node, total: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_splits of some rows of x, sorted by their nodes. Nodes are taken some at a time, so that sums stay small and cells have
    numbers of two bytes."""
    m, k = total.shape
    size, squares = total.sum(1), (total**2).sum(1)
    gain, feature, edge = LEAST * size, np.zeros(m, np.int64), np.zeros(m, np.int64)
    start, flat, width = np.searchsorted(node, np.arange(m + 1)), x.ravel(), x.shape[1]
    wide = len(rows) >= WIDE * m
    many = max(1, min((1 << 16) // max(BINS, k), max(1, (1 << 18) // (BINS * k)) if wide else 1 << 16))
    for lo in range(0, m if len(rows) else 0, many):
        hi = min(lo + many, m)
        own = slice(start[lo], start[hi])
        at, first = node[own] - lo, rows[own] * width
        ys, ws, part = y[own], w[own], (size[lo:hi], squares[lo:hi])
        if not wide:
            kinds = (at * k + ys).astype(np.uint16)
            groups = np.flatnonzero(np.concatenate([[True], np.diff(np.sort(kinds, kind="stable")) != 0, [True]]))
            more = (start[lo : hi + 1] - start[lo], kinds, groups, ws * total[lo:hi][at, ys])
        for f in chosen[lo:hi].T:
            bins = flat[first + f[at]]
            of, g, bin_ = _wide_gains(bins, ys, ws, at, total[lo:hi], *part) if wide else _narrow_gains(bins, ys, ws, at, *part, *more)
            better = g > gain[lo + of]
            of, g, bin_ = of[better], g[better], bin_[better]
            gain[lo + of], feature[lo + of], edge[lo + of] = g, f[of], bin_
    # what the sums above have lost by rounding is not taken for a gain
    left = flat[rows * width + feature[node]] <= edge[node]
    low = np.bincount(node[left] * k + y[left], w[left], m * k).reshape(m, k)
    high = np.bincount(node[~left] * k + y[~left], w[~left], m * k).reshape(m, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = (low**2).sum(1) / low.sum(1) + (high**2).sum(1) / high.sum(1) - ((low + high) ** 2).sum(1) / (low + high).sum(1)
    return np.where((gain > LEAST * size) & (exact > LEAST * size), exact, 0.0), feature, edge


def chosen_features(rng, nodes: int, width: int) -> np.ndarray:
    """The square root of all features, rounded up, for each node."""
    n = int(np.ceil(np.sqrt(width)))
    return np.argpartition(rng.random((nodes, width), np.float32), min(n, width - 1), 1)[:, :n]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, rng, whole: bool = False) -> Tree:
    """A tree of the rows of bins, level by level, until nodes are pure or nothing gains. whole: each node may use all features."""
    x, width = np.ascontiguousarray(x), x.shape[1]
    rows, node, levels, base = np.arange(len(y)), np.zeros(len(y), np.int64), [], 0
    m = 1
    for level in range(depth + 1):
        total = np.bincount(node * classes + y, w, m * classes).reshape(m, classes)
        mixed = np.flatnonzero((total > 0).sum(1) > 1)
        number = np.full(m, -1)
        number[mixed] = np.arange(len(mixed))
        keep = number[node] >= 0
        rows, y, w, node = rows[keep], y[keep], w[keep], node[keep]
        gain, feature, edge = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        if level < depth and len(mixed):
            chosen = np.broadcast_to(np.arange(width), (len(mixed), width)) if whole else chosen_features(rng, len(mixed), width)
            gain[mixed], feature[mixed], edge[mixed] = _sorted_splits(x, rows, y, w, number[node], total[mixed], chosen)
        split = gain > 0
        child = 2 * (np.cumsum(split) - 1)
        levels.append((feature, edge, np.where(split, base + m + child, 0), gain, total))
        if not split.any():
            break
        keep = split[node]
        rows, y, w, node = rows[keep], y[keep], w[keep], node[keep]
        node = child[node] + (x[rows, feature[node]] > edge[node])
        base, m = base + m, 2 * int(split.sum())
        order = np.argsort(node.astype(np.uint16) if m <= 1 << 16 else node, kind="stable")
        rows, y, w, node = rows[order], y[order], w[order], node[order]
    return _tree(*(np.concatenate(v) for v in zip(*levels)))


class _Growing:
    """The top of a tree: nodes that have been split on histograms, and open ones with their depths and rows."""

    def __init__(self, rows: int):
        self.feature, self.bin, self.left, self.gain = [0], [0], [0], [0.0]
        self.total: list = [None]
        self.open = {0: (0, rows)}

    def split(self, node: int, found: tuple) -> None:
        gain, feature, edge, sides = found
        depth, _ = self.open.pop(node)
        self.total[node] = sum(total for total, _ in sides)
        if gain <= 0:
            return
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, edge, len(self.left), gain
        for total, rows in sides:
            if np.count_nonzero(total) > 1:
                self.open[len(self.left)] = (depth + 1, rows)
            for column, v in ((self.feature, 0), (self.bin, 0), (self.left, 0), (self.gain, 0.0), (self.total, total)):
                column.append(v)

    def tree(self, classes: int) -> Tree:
        total = np.array([np.zeros(classes) if t is None else t for t in self.total])
        with np.errstate(invalid="ignore"):
            return _tree(*(np.array(v) for v in (self.feature, self.bin, self.left, self.gain)), total)


def _grafted(top: Tree, subs: dict[int, Tree]) -> Tree:
    """top with a tree in the place of each open node."""
    feature, edge, left, gain = [top.feature.copy()], [top.bin.copy()], [top.left.copy()], [top.gain.copy()]
    entries = [(np.repeat(np.arange(len(top.left)), np.diff(top.first)), top.of, top.share)]
    entries[0] = tuple(v[~np.isin(entries[0][0], list(subs))] for v in entries[0])
    base = len(top.left)
    for node, t in sorted(subs.items()):
        own = np.where(t.left > 0, t.left + (base - 1), 0)
        for column, v in ((feature, t.feature), (edge, t.bin), (left, own), (gain, t.gain)):
            column[0][node] = v[0]
            column.append(v[1:])
        at = np.repeat(np.arange(len(t.left)), np.diff(t.first))
        entries.append((np.where(at > 0, at + (base - 1), node), t.of, t.share))
        base += len(t.left) - 1
    at, of, share = (np.concatenate(v) for v in zip(*entries))
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(base + 1)).astype(np.int32)
    return Tree(*(np.concatenate(v) for v in (feature, edge, left, gain)), first, of[order], share[order])


def _blocks(rows, numbers: dict, edges: list[np.ndarray]):
    """Blocks of (bins, classes, weights) from rows of (features, label, weight)."""
    own = []

    def block():
        x, y, w = zip(*own)
        return binned(np.array(x), edges), np.array([numbers[v] for v in y]), np.array(w, float)

    for r in rows:
        own.append(r)
        if len(own) == BLOCK:
            yield block()
            own = []
    if own:
        yield block()


def _drawn(seed: int | None, tree: int, part: int, block: int, w: np.ndarray) -> np.ndarray:
    """Weights of a bootstrap's rows; 0 for those that it leaves out. Without a seed all rows are in it once."""
    return w if seed is None else np.random.default_rng([seed, tree, part, block]).poisson(1.0, len(w)) * w


def _opened(part: int, blocks, tops: dict[int, Tree], keys: dict[tuple[int, int], int], seed: int | None):
    """(tree, x, y, w, key) of rows in open nodes: keys numbers the (tree, node) asked for."""
    numbers = {t: np.full(len(top.left), -1) for t, top in tops.items()}
    for (t, node), key in keys.items():
        numbers[t][node] = key
    for b, (x, y, w) in enumerate(blocks):
        for t, top in tops.items():
            v = _drawn(seed, t, part, b, w)
            at = top.leaf_of(x)
            own = np.flatnonzero((numbers[t][at] >= 0) & (v > 0))
            yield t, x[own], y[own], v[own], numbers[t][at[own]]


def _histograms(part, blocks, tops, keys, seed, classes, chosen):
    """(key, (part, sums)): sums by chosen feature, bin and class, the last column of classes being rows."""
    sums = {key: np.zeros((chosen.shape[1], BINS, classes + 1)) for key in keys.values()}
    for _, x, y, w, key in _opened(part, blocks, tops, keys, seed):
        for one in np.unique(key).tolist():
            own = key == one
            for i, f in enumerate(chosen[one].tolist()):
                cells = x[own, f].astype(np.int64)
                sums[one][i, :, :-1] += np.bincount(cells * classes + y[own], w[own], BINS * classes).reshape(BINS, classes)
                sums[one][i, :, -1] += np.bincount(cells, minlength=BINS)
    return [(key, (part, s)) for key, s in sums.items()]


def _best(sums: np.ndarray, chosen: np.ndarray) -> tuple:
    """(gain, feature, bin, ((total, rows) of the left and of the right side)) from a node's histograms."""
    low = sums.cumsum(1)
    all_ = low[:, -1:, :]
    high = all_ - low
    a, b = low[:, :, :-1].sum(2), high[:, :, :-1].sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = (low[:, :, :-1] ** 2).sum(2) / a + (high[:, :, :-1] ** 2).sum(2) / b - (all_[:, :, :-1] ** 2).sum(2) / all_[:, :, :-1].sum(2)
    g[(low[:, :, -1] < 1) | (high[:, :, -1] < 1)] = -np.inf
    i, bin_ = divmod(int(np.argmax(g)), BINS)
    gain = float(g[i, bin_])
    found = gain if gain > LEAST * float(all_[i, 0, :-1].sum()) else 0.0
    # sums of a side without a class are exactly 0, not what rounding leaves
    sides = tuple((np.where(sums[i, s, :-1].any(0), v[i, bin_, :-1], 0.0), int(v[i, bin_, -1])) for v, s in ((low, slice(None, bin_ + 1)), (high, slice(bin_ + 1, None))))
    return found, int(chosen[i]), bin_, sides


def forest(rows: DataFrame, features: str, label: str, weight: str, trees: int, depth: int, seed: int, held: int = HELD):
    """(classes, edges, trees) of fitted()."""
    return fitted(rows, features, label, weight, trees, depth, seed, held)[:3]


def fitted(rows: DataFrame, features: str, label: str, weight: str, trees: int, depth: int, seed: int, held: int = HELD, whole: bool = False):
    """(classes, edges, trees, importances by tree and feature) from rows with a vector, a label and a weight. Trees are put together
    and written to the shared folder by tasks, and only read by the driver if they are small.

    Each tree is grown on a bootstrap of all rows: a row counts as often as a Poisson number says, which depends on the seed, the
    tree and the row's place in the sorted partitions. A node of more than held rows is split on histograms: each
    partition adds up its rows, and the driver gets the best split of each node alone. The rows of smaller nodes are sent
    to one task for each node, which grows the rest of the tree below it. Each node chooses among as many features as the
    square root of all. Nothing depends on the order of tasks. whole: instead, every tree is grown on all rows as they are, and
    nodes choose among all features."""
    flat = rows.select(vector_to_array(features).alias("x"), F.col(label).alias("y"), F.col(weight).cast("double").alias("w")).where("y is not null and w > 0")
    counts = sorted((r["y"], r["n"]) for r in flat.groupBy("y").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        raise ValueError("no rows to train on")
    edges = feature_edges(flat, total, BINS)
    numbers, classes, width = {c: i for i, (c, _) in enumerate(counts)}, len(counts), len(edges)
    parts = max(1, -(-total * (width + 16) // PART))
    made = flat.repartition(parts, "x") if parts > 1 else flat.coalesce(1)
    state = made.sortWithinPartitions("y", "x", "w").rdd.mapPartitions(lambda it: _blocks(it, numbers, edges))
    if whole:
        held = min(held, max(total // SHARED, OWN))
    draw = None if whole else seed
    growing = [_Growing(total) for _ in range(trees)]
    large = lambda: [(t, n) for t, g in enumerate(growing) for n, (d, r) in g.open.items() if r > held and d < depth]
    if large():
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
    while found := large():
        for lo in range(0, trees, TREES):
            keys = {tn: i for i, tn in enumerate(tn for tn in found if lo <= tn[0] < lo + TREES)}
            if not keys:
                continue
            tops = {t: growing[t].tree(classes) for t, _ in keys}
            if whole:
                chosen = np.broadcast_to(np.arange(width), (len(keys), width))
            else:
                chosen = np.concatenate([chosen_features(np.random.default_rng([seed, t, n, 1]), 1, width) for t, n in keys])
            sums = state.mapPartitionsWithIndex(lambda p, b: _histograms(p, b, tops, keys, draw, classes, chosen))
            splits = sums.groupByKey().mapValues(lambda v: sum(s for _, s in sorted(v, key=lambda x: x[0])))
            best = dict(splits.map(lambda x: (x[0], _best(x[1], chosen[x[0]]))).collect())
            for (t, n), i in keys.items():
                growing[t].split(n, best[i])
    tops = {t: g.tree(classes) for t, g in enumerate(growing)}
    keys = {tn: i for i, tn in enumerate((t, n) for t, g in enumerate(growing) for n in g.open)}
    names = [(t, n, depth - growing[t].open[n][0]) for t, n in keys]

    small = np.min_scalar_type(classes)

    def sent(part, blocks):
        for _, x, y, w, key in _opened(part, blocks, tops, keys, draw):
            for one in np.unique(key).tolist():
                own = key == one
                yield one, (part, x[own], y[own].astype(small), w[own])

    def finished(item):
        t, n, left = names[item[0]]
        own = sorted(item[1], key=lambda b: b[0])
        x, y, w = (np.concatenate([b[i] for b in own]) for i in (1, 2, 3))
        return t, (n, grow(x, y.astype(np.int64), w, classes, left, np.random.default_rng([seed, t, n, 2]), whole))

    def whole_tree(item):
        t, subs = item
        tree = _grafted(tops[t], {n: sub for n, sub in subs if sub is not None})
        stored = _stored(tree)
        return t, importance(tree, width).tolist(), sum(map(len, stored)), *stored

    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a bootstrap without a row gives a tree that says nothing
    made = spark.sparkContext.parallelize([(t, (0, None)) for t in range(trees)], 1)
    if keys:
        # blocks of a partition keep their order: a key's values come from it in turn, and the sort is stable
        many = max(cores, sum(growing[t].open[n][1] for t, n in keys) // (HELD // 2))
        made = made.union(state.mapPartitionsWithIndex(sent).groupByKey(min(len(keys), TASKS, many), lambda k: k).map(finished))
    made = made.groupByKey(min(trees, TASKS, max(cores, trees * total * NODE // WRITTEN)), lambda t: t).map(whole_tree)
    where = shared_folder(spark)
    spark.createDataFrame(made, STORED, verifySchema=False).write.partitionBy("tree").parquet(where)
    state.unpersist()
    return [c for c, _ in counts], edges, *_kept(spark, where)


class _Stored(MLWriter):
    """A model's classes with its metadata; a row for each feature's edges and for each tree, which is copied by tasks if it is in
    the shared folder."""

    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"classes": [int(c) for c in m.classes], "features": m.features})
        spark.createDataFrame([(f, e.tolist()) for f, e in enumerate(m.edges)], "feature int, edges array<double>").write.parquet(f"{path}/edges")
        if isinstance(m.trees, StoredTrees):
            trees = spark.read.schema(STORED).parquet(m.trees.where)
        else:
            rows = ((i, o.tolist(), b) for i, (o, b) in enumerate(zip(m.importances, map(_stored, m.trees))))
            trees = spark.createDataFrame([(i, o, sum(map(len, b)), *b) for i, o, b in rows], STORED)
        trees.write.partitionBy("tree").parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        said = DefaultParamsReader.loadMetadata(path, spark)
        edges = [np.array(r.edges, float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        out = ForestModel(said["classes"], edges, *_kept(spark, f"{path}/trees"), features=said["features"])
        out._resetUid(said["uid"])
        return out


class ForestModel(Model, MLWritable, MLReadable):
    """Adds probability (an array, in the order of classes: the mean of the trees' leaves) and prediction. Saved and loaded with the
    pipeline it is in."""

    def __init__(self, classes, edges, trees, importances=None, features: str = "features"):
        super().__init__()
        self.classes, self.edges, self.trees, self.features = classes, edges, trees, features
        self.importances = np.array([importance(t, len(edges)) for t in trees]) if importances is None else importances

    def write(self) -> MLWriter:
        return _Stored(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @property
    def featureImportances(self):
        """The mean over trees of each feature's share of what their splits took off the impurity."""
        out = self.importances.sum(0)
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _mean(self.trees, binned(x, self.edges), len(self.classes))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast((self.edges, self.trees))
        classes, features = self.classes, self.features

        @F.pandas_udf("array<double>")
        def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            edges, trees = held.value
            some: list[np.ndarray] = []

            def scored() -> pd.Series:
                return pd.Series(list(_mean(trees, np.concatenate(some), len(classes))))

            # stored trees are read once for so many rows
            for x in batches:
                if len(x):
                    some.append(binned(np.stack(x), edges))
                if sum(map(len, some)) >= SCORED:
                    yield scored()
                    some = []
            if some:
                yield scored()

        out = dataset.withColumn("probability", probability(vector_to_array(features)))
        top = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, classes)), top.cast("int")).cast("double"))


def _mean(trees: Sequence, bins: np.ndarray, classes: int) -> np.ndarray:
    """The mean of the trees' leaves for rows of bins."""
    out = np.zeros((len(bins), classes))
    for t in trees:
        out += t.shares(bins, classes)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


class RandomForest(Estimator):
    """fitted() as a pipeline's stage."""

    whole = False

    def __init__(self, trees: int = 300, depth: int = 30, seed: int = 7, featuresCol: str = "features", labelCol: str = "label", weightCol: str = "weight"):
        super().__init__()
        self.trees, self.depth, self.seed, self.features, self.label, self.weight = trees, depth, seed, featuresCol, labelCol, weightCol

    def getNumTrees(self) -> int:
        return self.trees

    def getMaxDepth(self) -> int:
        return self.depth

    def _fit(self, dataset: DataFrame) -> ForestModel:
        return ForestModel(*fitted(dataset, self.features, self.label, self.weight, self.trees, self.depth, self.seed, whole=self.whole), features=self.features)


class DecisionTree(RandomForest):
    """One tree of all rows and features."""

    whole = True

    def __init__(self, depth: int = 30, seed: int = 7, **columns: str):
        super().__init__(1, depth, seed, **columns)
