"""Training of classifiers and of an anomaly detector."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import margins, trees as grown
from .features import stratified_split

FOLDS = 5
MODELS = ("random_forest", "gradient_boosting", "logistic_regression", "svm")


def training_rows(
    rows: DataFrame, key: str, label: str, features: Sequence[str], seed: int, test_share: float = 0.2
) -> DataFrame:
    """``id, label, fold, x`` and each feature as ``x0, x1 ...``; fold -1 marks the test rows.

    The split and the folds are stratified by class and follow a hash of the row's
    key, so they are the same on every run. Features are scaled by the training
    rows' means and deviations; a missing value counts as the mean.
    """
    split = stratified_split(rows.where(F.col(label).isNotNull()), label, key, test_share, seed)
    split = split.withColumn("fold", F.when(F.col("is_test"), -1).otherwise(F.col("place") % FOLDS).cast("int"))
    split = materialise(split, "split")
    stats = split.where("fold >= 0").agg(
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(features)]
    ).first()
    scaled = [
        F.coalesce((F.col(c) - F.lit(stats[f"m{k}"])) / F.lit(stats[f"s{k}"] or 1.0), F.lit(0.0)).cast("double").alias(f"x{k}")
        for k, c in enumerate(features)
    ]
    ready = split.select(F.xxhash64(key).alias("id"), F.col(label).cast("int").alias("label"), "fold", *scaled)
    return materialise(ready.withColumn("x", F.array(*[f"x{k}" for k in range(len(features))])), "training")


def train_models(
    rows: DataFrame, key: str, label: str, features: Sequence[str], trees: int = 100, seed: int = 42,
    local_bytes: int = 64_000_000,
) -> DataFrame:
    """Train four classifiers and report their quality on held-out rows and in five folds.

    A random forest and boosted trees (100 each by default, the forest without a
    limit of depth), a logistic regression and a support vector machine on random
    Fourier features. The five folds' models and the final one are trained in the same
    passes. The result holds numbers only: ``model, ordinal``, the counts ``tp, fp,
    fn, tn`` on the test rows, what follows from them, ``cv_mean`` and ``cv_std`` of the
    folds' accuracies, and the rows that ``validated`` the folds.

    ``local_bytes``: training rows proven to be smaller are broadcast to grow whole
    trees in a task each; the trees are the same.
    """
    ready = training_rows(rows, key, label, features, seed)
    width, fits = len(features), FOLDS + 1
    names = [f"x{k}" for k in range(width)]
    cells = grown.binned(ready, names, grown.bin_edges(ready.where("fold >= 0"), names))
    kernel = margins.fourier(width, seed)
    votes = {
        "random_forest": grown.forest_votes(cells, grown.forest(cells, width, fits, trees, seed, local_bytes), width, fits),
        "gradient_boosting": grown.boosted_votes(
            cells, grown.boosted(cells, width, fits, trees, seed=seed, local_bytes=local_bytes), width, fits
        ),
        "logistic_regression": margins.votes(
            ready, margins.newton(ready, width, fits, margins.logistic, margins.plain), fits, margins.plain
        ),
        "svm": margins.votes(ready, margins.newton(ready, width, fits, margins.squared_hinge, kernel), fits, kernel),
    }
    counted = reduce(
        DataFrame.unionByName,
        [
            votes[name].groupBy("fit", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("model"), F.lit(k).alias("ordinal"), "fit", "label", "prediction", "n")
            for k, name in enumerate(MODELS)
        ],
    )
    return model_quality(materialise(counted, "confusion"))


def model_quality(counts: DataFrame) -> DataFrame:
    """Quality per model from ``model, ordinal, fit, label, prediction, n``; the largest fit is that of the test rows."""
    n = lambda y, p: F.coalesce(
        F.sum(F.when((F.col("fit") == FOLDS) & (F.col("label") == y) & (F.col("prediction") == p), F.col("n"))), F.lit(0)
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    per_fold = (
        counts.where(F.col("fit") < FOLDS)
        .groupBy("model", "fit")
        .agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("hit"), F.sum("n").alias("rows"))
        .groupBy("model")
        .agg(F.avg("hit").alias("cv_mean"), F.stddev_pop("hit").alias("cv_std"), F.sum("rows").alias("validated"))
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tested = counts.groupBy("model", "ordinal").agg(
        n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn")
    )
    return (
        tested.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .join(per_fold, "model", "left")
    )


# ---- isolation forest ----------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes ``[feature, cut, left, right, depth estimate]`` of one tree; leaves have feature -1."""
    nodes: list[list[float]] = []
    queue = [(points, 0, -1, 0)]
    while queue:
        rows, depth, parent, side = queue.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(low[f], high[f])
        nodes.append([f, cut, -1, -1, 0.0])
        left = rows[:, f] < cut
        queue += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
    return nodes


def isolation_forest(
    df: DataFrame, key: str, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Anomaly score between 0 and 1 per row; rows that are easy to separate score high.

    Every tree is grown by its own task from ``sample`` rows, picked by the
    smallest hashes of row id and tree number. Each task offers only rows whose
    hash lies in the lowest part that is sure to hold the sample.
    """
    features = list(features)
    filled = df.dropna(subset=features).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    total = max(filled.count(), 1)
    part = min(1.0, 4.0 * sample / total)
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.xxhash64(F.col(key), t, F.lit(seed)).alias("draw")
        ),
    )
    limit = int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1
    offered = filled.select(
        key, *features, F.inline(F.filter(draws, lambda d: d["draw"] <= F.lit(limit)))
    )
    order = Window.partitionBy("tree").orderBy("draw", key)
    chosen = offered.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", key])
        tree = int(rows["tree"].iloc[0])
        nodes = _grow(rows[features].to_numpy(), np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame({"tree": [tree], "nodes": [nodes]})

    forest = chosen.groupBy("tree").applyInPandas(build, "tree int, nodes array<array<double>>")
    # Bounded by trees * 2 * sample nodes, whatever the size of the table.
    grown = [np.array(r["nodes"]) for r in forest.orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    norm = float(_average_path(min(sample, total))) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy() for c in columns])
        path = np.zeros(len(x))
        for nodes in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = nodes[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                right = x[inner, f[inner]] >= nodes[here, 1]
                at[inner] = np.where(right, nodes[here, 3], nodes[here, 2]).astype(int)
            path += nodes[at, 4]
        return pd.Series(2.0 ** (-(path / len(shared.value)) / norm))

    return filled.select(key, score(*features).alias("anomaly"))
