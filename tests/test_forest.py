"""The forest against plain versions: splits, whole trees, nodes split on histograms, and how many jobs a fit starts."""

import pickle

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array

from flowmill.operators import forest as fo


def plain_gain(x, y, w, f, edge, k):
    def score(rows):
        t = np.bincount(y[rows], w[rows], k)
        return (t**2).sum() / t.sum()

    left = x[:, f] <= edge
    return score(left) + score(~left) - score(left | ~left) if left.any() and not left.all() else -np.inf


def test_best_splits_are_those_of_a_plain_search():
    rng = np.random.default_rng(1)
    n, m, k = 300, 7, 4
    x, y, w, node = rng.integers(0, fo.BINS, (n, 5)).astype(np.uint8), rng.integers(0, k, n), rng.integers(1, 4, n) * 0.5, rng.integers(0, m, n)
    total = np.bincount(node * k + y, w, m * k).reshape(m, k)
    chosen = fo.chosen_features(rng, m, 5)
    gain, feature, edge = fo.best_splits(x, y, w, node, total, chosen)
    for i in range(m):
        own = node == i
        best = max(plain_gain(x[own], y[own], w[own], f, e, k) for f in chosen[i] for e in range(fo.BINS))
        assert np.isclose(gain[i], best) and feature[i] in chosen[i]
        assert np.isclose(plain_gain(x[own], y[own], w[own], feature[i], edge[i], k), best)
        sums = np.zeros((chosen.shape[1], fo.BINS, k + 1))
        for j, f in enumerate(chosen[i]):
            np.add.at(sums[j], (x[own, f], y[own]), w[own])
            np.add.at(sums[j], (x[own, f], k), 1)
        found, f, e, sides = fo._best(sums, chosen[i])
        left = own & (x[:, f] <= e)
        assert np.isclose(found, best) and sides[0][1] == left.sum() and np.allclose(sides[0][0], np.bincount(y[left], w[left], k))


def test_a_tree_is_grown_until_nodes_are_pure():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, fo.BINS, (500, 6)).astype(np.uint8), rng.integers(0, 3, 500)
    p = fo.grow(x, y, np.ones(500), 3, 30, np.random.default_rng(0)).shares(x, 3)
    assert (p.argmax(1) == y).all() and (p.max(1) == 1).all()
    low = fo.grow(x, y, np.ones(500), 3, 2, np.random.default_rng(0))
    assert (low.left > 0).sum() <= 3 and np.allclose(low.shares(x, 3).sum(1), 1)


def data(spark, n=700, width=6):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] + 0.2 * x[:, 2] > 0)
    rows = [(v.tolist(), int(c), 2.0 if c == 3 else 1.0) for v, c in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, label int, weight double")
    return x, y, df.select(array_to_vector("x").alias("features"), "label", "weight").persist()


def test_large_nodes_are_split_on_histograms_of_all_partitions(spark, monkeypatch):
    """Trees whose tops are split on histograms classify as those that are grown in one task; the same call gives the same trees."""
    x, y, df = data(spark)
    monkeypatch.setattr(fo, "PART", 4096)
    monkeypatch.setattr(fo, "BLOCK", 50)
    again = None
    for held in (10_000, 60, 60):
        classes, edges, trees = fo.forest(df, "features", "label", "weight", 30, 30, 7, held=held)
        p = fo.ForestModel(classes, edges, trees).probabilities(x)
        assert classes == [0, 1, 2, 3] and (p.argmax(1) == y).mean() > 0.98 and np.allclose(p.sum(1), 1)
        shares = fo.ForestModel(classes, edges, trees).featureImportances.toArray()
        assert np.isclose(shares.sum(), 1) and shares[:2].sum() > 0.7
        if again is not None and held == 60:
            assert all(np.array_equal(a, b) for s, t in zip(again, trees) for a, b in zip(s, t))
        again = trees if held == 60 else None


def test_jobs_do_not_grow_with_trees_and_depth(spark):
    """Nodes that fit a task are finished in it; the forest before started jobs for each level and each 256 MB of nodes."""
    from flowmill.operators import training as tr

    _, _, df = data(spark)
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        tr.candidates(trees=40)["forest"][1].fit(df)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_large_forests_stay_in_the_shared_folder(spark, monkeypatch, tmp_path):
    """The driver holds where the trees are, not the trees; they score, count and are stored as those that it holds."""
    x, y, df = data(spark)
    held = fo.RandomForest(20, 30).fit(df)
    monkeypatch.setattr(fo, "KEPT", 0, raising=False)
    model = fo.RandomForest(20, 30).fit(df)
    assert len(pickle.dumps(model.trees)) < 500 < len(pickle.dumps(held.trees[0])) and len(model.trees) == 20
    assert all(np.array_equal(a, b) for s, t in zip(held.trees, model.trees) for a, b in zip(s, t))
    assert np.array_equal(model.featureImportances.toArray(), held.featureImportances.toArray())
    model.save(f"file://{tmp_path}/m")
    rows = df.withColumn("x", vector_to_array("features"))
    told = [sorted((r.x, r.probability, r.prediction) for r in m.transform(rows).collect()) for m in (held, model, fo.ForestModel.load(f"file://{tmp_path}/m"))]
    assert told[0] == told[1] == told[2] and len(told[0]) == len(y)
    assert np.array_equal(model.trees[-1].feature, held.trees[-1].feature) and [len(t.left) for t in model.trees[2:4]] == [len(t.left) for t in held.trees[2:4]]


def test_a_tree_alone_is_grown_by_many_tasks_and_few_jobs(spark, monkeypatch):
    """One tree of all rows: its top split on histograms or not, it tells all rows apart; the tree before took jobs for each level."""
    from flowmill.operators import training as tr

    x, y, df = data(spark)
    sc = spark.sparkContext
    sc.setJobGroup("tree", "tree")
    try:
        one = tr.candidates()["tree"][1].fit(df)
        assert len(sc.statusTracker().getJobIdsForGroup("tree")) <= 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(fo, "PART", 4096)
    monkeypatch.setattr(fo, "OWN", 100)
    many = tr.candidates()["tree"][1].fit(df)
    for model in (one, many):
        p = model.probabilities(x)
        assert len(model.trees) == 1 and (p.argmax(1) == y).all() and (p.max(1) == 1).all()
    first, again = (m.trees[0] for m in (one, many))
    assert (first.feature[0], first.bin[0]) == (again.feature[0], again.bin[0]) and np.isclose(first.gain[0], again.gain[0])
