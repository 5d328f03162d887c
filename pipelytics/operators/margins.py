"""Linear models under a quadratic penalty, by Newton's method on sums that Spark adds up.

A step is one pass over the rows for all fits at once: every task adds up loss,
gradient and curvature of its rows, Spark adds up the tasks', and the driver
solves one system per fit whose size is the number of inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

Expand = Callable[[np.ndarray], np.ndarray]


def plain(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def fourier(width: int, seed: int, size: int = 200) -> Expand:
    """Random Fourier features, on which a linear model acts like a kernel exp(-|x - y|^2 / width)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 / width), (width, size))
    offsets = rng.uniform(0, 2 * np.pi, size)
    return lambda x: plain(np.sqrt(2.0 / size) * np.cos(x @ weights + offsets))


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of log(1 + exp(-m))."""
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
    return np.logaddexp(0, -margin), -p, p * (1 - p)


def squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of max(0, 1 - m) squared."""
    short = np.maximum(0.0, 1 - margin)
    return short**2, -2 * short, 2.0 * (short > 0)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    labels, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
    return np.stack(batch.column(2).to_pylist()).astype(np.float64).reshape(len(labels), -1), labels, folds


def newton(
    rows: DataFrame, width: int, fits: int, loss: Callable, expand: Expand, penalty: float = 1.0, rounds: int = 100,
    tolerance: float = 1e-6,
) -> np.ndarray:
    """Weights per fit from ``label`` (0 or 1), ``fold`` (-1: test row) and ``x``; the last input is the constant.

    A step that raises the loss is halved. Raises if a fit has not settled after ``rounds`` passes.
    """
    spark = rows.sparkSession
    size = expand(np.zeros((1, width))).shape[1]
    upper = np.triu_indices(size)
    cells = 1 + size + len(upper[0])
    ridge = np.append(np.ones(size - 1), 0.0) * penalty
    picked = rows.where("fold >= 0").select("label", "fold", "x")

    def evaluate(weights: np.ndarray, wanted: list[int]) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(wanted), cells))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, labels, folds = _rows(batch)
                z, sign = expand(x), np.where(labels == 1, 1.0, -1.0)
                for k, fit in enumerate(wanted):
                    held = folds != fit
                    own, y = z[held], sign[held]
                    value, slope, curve = loss(y * (own @ shared.value[fit]))
                    sums[k, 0] += value.sum()
                    sums[k, 1 : 1 + size] += own.T @ (slope * y)
                    sums[k, 1 + size :] += ((own * curve[:, None]).T @ own)[upper]
            fit = np.repeat(np.array(wanted, dtype=np.int32), cells)
            place = np.tile(np.arange(cells, dtype=np.int32), len(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(place), pa.array(sums.ravel())], names=["fit", "place", "value"])

        found = picked.mapInArrow(run, "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value"))
        table = found.toPandas()
        out = {}
        for fit in wanted:
            own = table[table["fit"] == fit]
            out[fit] = np.zeros(cells)
            out[fit][own["place"]] = own["value"]
        return out

    at = np.zeros((fits, size))
    trial, best = at.copy(), np.full(fits, np.inf)
    moving = list(range(fits))
    for _ in range(rounds):
        for fit, sums in evaluate(trial, moving).items():
            w = trial[fit]
            value = sums[0] + 0.5 * (ridge * w * w).sum()
            if value > best[fit] * (1 + 1e-12):
                trial[fit] = (at[fit] + w) / 2
                if np.abs(trial[fit] - at[fit]).max() < 1e-12:
                    moving.remove(fit)
                continue
            at[fit], best[fit] = w.copy(), value
            gradient = sums[1 : 1 + size] + ridge * w
            curvature = np.zeros((size, size))
            curvature[upper] = sums[1 + size :]
            curvature = curvature + np.triu(curvature, 1).T + np.diag(ridge + 1e-9)
            if np.abs(gradient).max() <= tolerance * max(1.0, value):
                moving.remove(fit)
                continue
            trial[fit] = w - np.linalg.solve(curvature, gradient)
        if not moving:
            return at
    raise RuntimeError(f"no settled weights after {rounds} passes")


def votes(rows: DataFrame, weights: np.ndarray, fits: int, expand: Expand) -> DataFrame:
    """``fit, label, prediction`` for the rows that a fit has not learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, labels, folds = _rows(batch)
            z = expand(x)
            for fit in range(fits):
                mine = np.flatnonzero(folds == (fit if fit < fits - 1 else -1))
                if len(mine):
                    columns = [np.full(len(mine), fit), labels[mine], (z[mine] @ weights[fit] > 0).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["fit", "label", "prediction"])

    picked = rows.select("label", "fold", "x")
    return materialise(picked.mapInArrow(run, "fit int, label int, prediction int"), "votes")
