"""Histogram boosting against a plain version, and over partitions against one."""

import numpy as np
from pyspark.ml.feature import VectorAssembler

from flowmill.operators import boosting as bo


def table(spark, n=300, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 3)) * 4)
    y = ((x[:, 0] > 1).astype(int) + (x[:, 1] * x[:, 0] > 2)) % classes
    df = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(y, x)], "label int, a double, b double, c double")
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def plain(x, y, rounds, classes):
    """Margins after all rounds: for every node every feature and value is tried on the rows themselves."""
    margins = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(rounds):
        g, h = bo.slopes(margins, y)
        add = np.zeros_like(margins)
        for k in range(classes):
            leaves, frontier = [], [np.arange(len(y))]
            for _ in range(bo.DEPTH):
                found = []
                for own in frontier:
                    best = (1e-10, None)
                    for f in range(x.shape[1]):
                        for v in np.unique(x[:, f])[:-1]:
                            left = own[x[own, f] <= v]
                            right = own[x[own, f] > v]
                            if min(len(left), len(right)) >= bo.LEAF_ROWS:
                                gain = sum(g[s, k].sum() ** 2 / h[s, k].sum() * w for s, w in ((left, 1), (right, 1), (own, -1)))
                                if gain > best[0] + 1e-9:
                                    best = (gain, (left, right))
                    found.append((best, own))
                leaves += [own for best, own in found if best[1] is None]
                frontier = [s for best, _ in found if best[1] for s in best[1]]
            for own in [*leaves, *frontier]:
                add[own, k] = -bo.STEP * g[own, k].sum() / h[own, k].sum()
        margins += add
    return margins


def test_trees_equal_plain_ones(spark):
    x, y, rows = table(spark)
    model = bo.BoostedModel(*bo.boost(rows, "features", "label", 6))
    assert model.classes == [0, 1, 2] and np.allclose(model.margins(x), plain(x, y, 6, 3), atol=1e-9)


def test_partitions_and_blocks_do_not_change_the_trees(spark, monkeypatch):
    x, _, rows = table(spark)
    one = bo.BoostedModel(*bo.boost(rows, "features", "label", 3))
    monkeypatch.setattr(bo, "PART", 3000)
    monkeypatch.setattr(bo, "FEATURES", 2)
    monkeypatch.setattr(bo, "WRITTEN", 2)
    made = bo.boost(rows.repartition(5), "features", "label", 3)
    again = bo.boost(rows.repartition(3), "features", "label", 3)
    assert np.allclose(bo.BoostedModel(*made).margins(x), one.margins(x), atol=1e-9)
    assert all(np.array_equal(a.value, b.value) for r, s in zip(made[3], again[3]) for a, b in zip(r, s))


def test_classes_grow_in_tasks_of_their_own(spark, monkeypatch):
    """A round of few rows is one job with a task for each class; how often trees join the margins changes nothing."""
    sc, (x, _, rows) = spark.sparkContext, table(spark)
    sc.setJobGroup("boost-few", "")
    one = bo.boost(rows, "features", "label", 5)
    sc.setJobGroup("", "")
    status = sc.statusTracker()
    tasks = [status.getStageInfo(max(status.getJobInfo(j).stageIds)).numTasks for j in status.getJobIdsForGroup("boost-few")]
    assert tasks.count(3) >= 5
    monkeypatch.setattr(bo, "FEW", 1, raising=False)
    monkeypatch.setattr(bo, "WRITTEN", 2)
    assert all(np.array_equal(a.value, b.value) for r, s in zip(one[3], bo.boost(rows, "features", "label", 5)[3]) for a, b in zip(r, s))


def test_scores_are_probabilities(spark):
    x, y, rows = table(spark)
    out = bo.HistogramBoosting(rounds=20).fit(rows).transform(rows).select("label", "probability", "prediction").collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.prediction == float(np.argmax(r.probability)) for r in out)
    shares = bo.HistogramBoosting(rounds=5).fit(rows).featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[0] > shares[2] >= 0
    assert np.mean([r.label == r.prediction for r in out]) > 0.9


def test_bins():
    v = np.array([3.0, 1.0, 1.0, 2.0])
    assert bo.edges_of(v).tolist() == [1.5, 2.5] and bo.binned(v[:, None], [bo.edges_of(v)]).ravel().tolist() == [2, 0, 0, 1]
    many = bo.edges_of(np.arange(10_000.0))
    assert len(many) == 254 and bo.binned(np.array([[-1.0], [1e9]]), [many]).ravel().tolist() == [0, 254]
    assert bo.edges_of(np.ones(5)).tolist() == []


def test_of_two_children_the_smaller_is_added_up(monkeypatch):
    rng = np.random.default_rng(3)
    n = 4000
    x, y = np.asfortranarray(rng.integers(0, 50, (n, 4)).astype(np.uint8)), rng.integers(0, 3, n)
    counted, plain = [], bo.histogram
    monkeypatch.setattr(bo, "histogram", lambda x, g, h, leaves, nodes, *more: counted.append(int(np.isin(leaves, nodes).sum())) or plain(x, g, h, leaves, nodes, *more))
    tree = bo._own_tree([(x, y, np.asfortranarray(np.zeros((n, 3))))], 1, 50)
    assert counted[0] == n and len(counted) == bo.DEPTH and all(c <= n / 2 for c in counted[1:])
    g, h = (v[:, 1] for v in bo.slopes(np.zeros((n, 3)), y))
    whole = bo._round(1, lambda t, o: [((0, 0), bo.best_splits(plain(x, g, h, t[0].leaf_of(x), o[0], 50)))])[0]
    assert all(np.array_equal(a, b) for a, b in zip(tree[:3], whole[:3])) and np.allclose(tree.value, whole.value, atol=1e-12)
    slow = tree.leaf_of(np.ascontiguousarray(x))
    assert np.array_equal(tree.leaf_of(x), slow)
