"""Trees and linear models against numpy, and the two ways of growing trees against each other."""

import inspect
import itertools
import pickle

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from pipelytics.operators import learning as l
from pipelytics.operators import margins, trees


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.random((300, 3))
    y = ((x[:, 0] + x[:, 1] - x[:, 2] > 0.5) ^ (rng.random(300) < 0.05)).astype(int)
    rows = [(i, *map(float, row), int(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(3)


@pytest.fixture(scope="module")
def cells(points):
    ready = l.training_rows(points, "id", "y", ["a", "b", "c"], 1)
    names = ["x0", "x1", "x2"]
    return trees.binned(ready, names, trees.bin_edges(ready, names))


def test_four_models_learn(points):
    got = {r.model: r for r in l.train_models(points, "id", "y", ["a", "b", "c"], trees=10).collect()}
    assert set(got) == set(l.MODELS)
    assert all(r.accuracy > 0.75 and r.cv_mean > 0.75 and r.validated == 241 for r in got.values())
    assert {r.tp + r.fp + r.fn + r.tn for r in got.values()} == {59}


def test_registered_models_are_grown_whole():
    assert inspect.signature(l.train_models).parameters["trees"].default == 100


def test_missing_values_and_labels(spark, points):
    odd = points.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a"))).withColumn("b", F.lit(None).cast("double"))
    odd = odd.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    got = l.train_models(odd, "id", "y", ["a", "b", "c"], trees=3).collect()
    assert len(got) == 4 and {r.tp + r.fp + r.fn + r.tn + r.validated for r in got} == {299}


def same(a, b):
    return all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "bin", "left", "right", "sums"))


def test_forest_is_the_same_either_way(cells):
    whole = trees.forest(cells, 3, 6, 2, 5)
    levels = trees.forest(cells, 3, 6, 2, 5, local_bytes=0)
    assert whole.keys() == levels.keys() and len(whole) == 12
    assert all(same(whole[k], levels[k]) for k in whole)
    # Grown out: every leaf holds one class, or rows that no cut tells apart.
    tree = whole[5, 0]
    leaves = tree.feature < 0
    assert ((tree.sums[leaves, 1:] > 0).sum(axis=1) == 1).mean() > 0.95


@pytest.mark.parametrize("local_bytes", [64_000_000, 0])
def test_the_forest_stays_out_of_the_driver(cells, monkeypatch, local_bytes):
    sent = []

    def weighed(kind, name, brought):
        plain = getattr(kind, name)

        def run(self, *args, **named):
            out = plain(self, *args, **named)
            out = list(out) if name == "toLocalIterator" else out
            sent.append(len(pickle.dumps(out if brought else args[0])))
            return iter(out) if name == "toLocalIterator" else out

        monkeypatch.setattr(kind, name, run)

    for name in ("collect", "toPandas", "toLocalIterator", "toArrow"):
        weighed(type(cells), name, True)
    weighed(SparkContext, "broadcast", False)
    model = trees.forest(cells, 3, 6, 8, 5, local_bytes=local_bytes)
    voted = trees.forest_votes(cells, model, 3, 6)
    monkeypatch.undo()
    model = dict(model.items())
    nodes = sum(len(tree.feature) for tree in model.values())
    assert nodes * 56 > 100_000 > 4 * max(sent)
    # The votes are those of the trees.
    expected = []
    ids, labels, folds, bins = trees._arrays(cells.toArrow().combine_chunks().to_batches()[0], 3)
    for fit in range(6):
        mine = folds == (fit if fit < 5 else -1)
        share = np.zeros(mine.sum())
        for tree in (model[fit, k] for k in range(8)):
            n, _, ones = tree.sums.T
            share += (ones / n)[tree.leaves(bins[mine])]
        expected += zip(itertools.repeat(fit), labels[mine].tolist(), (share > 4).astype(int).tolist())
    assert sorted(map(tuple, voted.collect())) == sorted(expected)


def test_a_tree_in_pieces(cells, monkeypatch):
    whole = trees.forest(cells, 3, 6, 2, 5)
    monkeypatch.setattr(trees, "PIECE", 7)
    monkeypatch.setattr(trees, "BLOCK", 30)
    votes = [sorted(map(tuple, trees.forest_votes(cells, trees.forest(cells, 3, 6, 2, 5, n), 3, 6).collect())) for n in (10**6, 0)]
    monkeypatch.undo()
    assert votes[0] == votes[1] == sorted(map(tuple, trees.forest_votes(cells, whole, 3, 6).collect()))


def test_any_label_of_a_row_is_kept(cells):
    """Labels other than 0 and 1 are counted under their own number."""
    odd = cells.withColumn("label", F.when(F.col("label") == 0, 300).otherwise(F.col("label")))
    voted = trees.forest_votes(odd, trees.forest(odd, 3, 6, 1, 5), 3, 6)
    assert {r.label for r in voted.collect()} == {1, 300}


def test_boosting_is_the_same_either_way(cells):
    whole = trees.boosted(cells, 3, 6, 3)
    levels = trees.boosted(cells, 3, 6, 3, local_bytes=0)
    for fit in range(6):
        assert whole[fit][0] == pytest.approx(levels[fit][0], abs=1e-12)
        for (a, u), (b, v) in zip(whole[fit][1], levels[fit][1], strict=True):
            assert same(a, b) and u == pytest.approx(v, abs=1e-9)


def test_no_limit_of_depth():
    n = 120
    bins = np.arange(n)[:, None]
    labels = np.arange(n) % 2
    sums = np.stack([np.ones(n), labels == 0, labels == 1], axis=1).astype(np.int64)
    tree, at = trees.grow(bins, sums, 1, 3)
    assert (tree.feature < 0).sum() == n and len(set(at.tolist())) == n
    assert (tree.leaves(bins) == at).all()


def test_best_cut_against_every_cut():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 9, (80, 4))
    labels = rng.integers(0, 2, 80)
    sums = np.stack([np.ones(80), labels == 0, labels == 1], axis=1).astype(np.int64)
    _, features, cuts = trees.best_cuts(*trees.histogram(np.zeros(80, dtype=np.int64), bins, sums), 4, 0)
    worth = {}
    for f, c in itertools.product(range(4), range(8)):
        left = sums[bins[:, f] <= c].sum(axis=0).astype(float)
        right = sums[bins[:, f] > c].sum(axis=0).astype(float)
        if left[0] and right[0]:
            worth[f, c] = (left[1:] ** 2).sum() / left[0] + (right[1:] ** 2).sum() / right[0]
    assert worth[features[0], cuts[0]] == pytest.approx(max(worth.values()))


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 50, (400, 2))
    labels = (bins[:, 0] > bins[:, 1]).astype(np.int64)
    score = np.zeros(400)
    losses = []
    for _ in range(20):
        left, curve = trees._gradient(labels, score)
        tree, at = trees.grow(bins, np.stack([np.ones_like(left), left], axis=1), 2, 0, 3)
        assert len(tree.feature) <= 15
        per_node = np.zeros(len(tree.feature), dtype=np.int64)
        np.add.at(per_node, at, curve)
        score += trees._steps(tree, per_node, 0.1)[at]
        losses.append(np.logaddexp(0, -np.where(labels == 1, score, -score)).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.45


@pytest.mark.parametrize("loss", [margins.logistic, margins.squared_hinge])
def test_weights_are_where_the_loss_is_least(spark, loss):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1]
    labels = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    rows = [(int(y), int(i % 6) - 1, [float(v) for v in r]) for i, (y, r) in enumerate(zip(labels, x))]
    frame = spark.createDataFrame(rows, "label int, fold int, x array<double>").repartition(4)
    found = margins.newton(frame, 3, 6, loss, margins.plain)
    folds, z, sign = np.arange(200) % 6 - 1, margins.plain(x), np.where(labels == 1, 1.0, -1.0)

    def total(w, fit):
        held = (folds >= 0) & (folds != fit)
        return loss(sign[held] * (z[held] @ w))[0].sum() + 0.5 * (w[:-1] ** 2).sum()

    for fit in range(6):
        least = total(found[fit], fit)
        for step in rng.normal(size=(50, 4)) * 1e-2:
            assert total(found[fit] + step, fit) >= least


def test_separable_rows_settle(spark):
    rows = [(int(v > 0), 0, [float(v)]) for v in (-3, -2, -1, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "label int, fold int, x array<double>")
    assert margins.newton(frame, 1, 6, margins.logistic, margins.plain)[5, 0] > 0
