"""Vectors, matrices and series."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

_UNIT = 1e9
# Partial sums stay below this, well within 64 bits.
LARGEST_SUM = 2.0**62


def batch_score_median(vectors: DataFrame, batch: int = 1000) -> DataFrame:
    """Sum of each vector, and whether it exceeds the median sum of its batch of ids.

    A batch holds at most ``batch`` ids, which bounds every group.
    """
    total = F.aggregate(
        "embedding",
        F.lit(0).cast("decimal(37,9)"),
        lambda acc, v: (acc + v.cast("double").cast("decimal(30,9)")).cast("decimal(37,9)"),
    )
    scored = vectors.select(
        "vec_id", F.floor(F.col("vec_id") / batch).cast("bigint").alias("batch"),
        total.cast("double").alias("score"),
    )
    medians = scored.groupBy("batch").agg(F.median("score").alias("batch_median"))
    return scored.join(medians, "batch").withColumn(
        "above_median", F.col("score") > F.col("batch_median")
    )


def gram_matrix(vectors: DataFrame, block: str, held_bytes: int = 256_000_000, tile_bytes: int = 32_000_000) -> DataFrame:
    """Products of every two columns, summed over the vectors of each block (upper triangle).

    Each task adds up its own vectors into one matrix per block, so what is
    shuffled depends on the width of the vectors and not on their number. Products
    are held in two parts, whole units and billionths, which makes the sums exact;
    those of 2**62 and more, which have no billionths, are summed as doubles. The
    products of some rows are made for one tile of the matrix at a time, within
    ``tile_bytes``, and a task passes its matrices on when they take ``held_bytes``.
    Vectors must have one width and finite values; null vectors are left out.
    """

    def rows_of(sums: dict) -> Iterator[pd.DataFrame]:
        for key, parts in sums.items():
            width = parts.shape[1]
            for start in range(0, width, 256):
                i, j = np.triu_indices(min(256, width - start), start, width)
                i = i + start
                yield pd.DataFrame(
                    {block: key, "i": i + 1, "j": j + 1, "units": parts[0, i, j].astype("int64"),
                     "billionths": parts[1, i, j].astype("int64"), "large": parts[2, i, j].view("float64")}
                )

    def add(parts: np.ndarray, x: np.ndarray) -> None:
        width = x.shape[1]
        edge = min(width, 128)
        step = max(1, tile_bytes // (edge * edge * 8))
        for start in range(0, len(x), step):
            rows = x[start : start + step]
            for a in range(0, width, edge):
                for b in range(a, width, edge):
                    tile = rows[:, a : a + edge, None] * rows[:, None, b : b + edge]
                    large = np.abs(tile) >= LARGEST_SUM
                    place = (slice(a, a + edge), slice(b, b + edge))
                    if large.any():
                        parts[2][place].view("float64")[...] += np.where(large, tile, 0.0).sum(axis=0)
                        tile = np.where(large, 0.0, tile)
                    whole = np.rint(tile)
                    parts[0][place] += whole.astype("int64").sum(axis=0)
                    parts[1][place] += np.rint((tile - whole) * _UNIT).astype("int64").sum(axis=0)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        used = 0.0
        for frame in frames:
            for key, rows in frame.groupby(block, dropna=False):
                x = np.stack(rows["embedding"].to_numpy()).astype("float64")
                peak = float(np.abs(x).max(initial=0.0)) ** 2
                if not np.isfinite(peak):
                    raise ValueError("vectors must be finite, and so must their products")
                # Rows at a time, so that no sum of whole units leaves 64 bits.
                step = int(max(1, min(len(x), LARGEST_SUM // max(min(peak, LARGEST_SUM), 1.0))))
                for start in range(0, len(x), step):
                    y = x[start : start + step]
                    most = min(peak, LARGEST_SUM) * len(y)
                    used += most
                    if used > LARGEST_SUM or (len(sums) + 1) * y.shape[1] ** 2 * 24 > max(held_bytes, y.shape[1] ** 2 * 24):
                        yield from rows_of(sums)
                        sums, used = {}, most
                    if key not in sums:
                        sums[key] = np.zeros((3, y.shape[1], y.shape[1]), dtype="int64")
                    add(sums[key], y)
        yield from rows_of(sums)

    kind = vectors.schema[block].dataType.simpleString()
    cells = vectors.where(F.col("embedding").isNotNull()).select(block, "embedding").mapInPandas(
        partial, f"{block} {kind}, i int, j int, units bigint, billionths bigint, large double"
    )
    units, billionths = (F.sum(F.col(c).cast("decimal(28,0)")) for c in ("units", "billionths"))
    both = (units * F.lit(Decimal(10**9)) + billionths).cast("double") / _UNIT
    exact = F.when(F.abs(units) < F.lit(Decimal(10**28)), both).otherwise(units.cast("double"))
    return cells.groupBy(block, "i", "j").agg((exact + F.sum("large")).alias("product"))


def svd_summary(vectors: DataFrame, k: int, stack_bytes: int = 64_000_000) -> DataFrame:
    """The ``k`` largest singular values of the matrix whose rows are the vectors.

    A tall matrix is cut into the tasks' rows. Each task turns its own into a
    triangular factor as wide as one vector, then tasks stack a few factors and factor
    them again, until one is left, whose singular values are those of the whole. No
    product of columns is formed, so small values keep their digits. A stack takes
    about ``stack_bytes``, two factors at least. Null vectors are left out.
    """

    def factor(stack: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate([stack, rows]), mode="r")

    def packed(number: int, stack: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": [number] * len(stack), "line": list(stack)})

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack = None
        for frame in frames:
            for start in range(0, len(frame), 4096):
                rows = np.stack(frame["embedding"].iloc[start : start + 4096].to_numpy()).astype("float64")
                stack = factor(np.zeros((0, rows.shape[1])) if stack is None else stack, rows)
        if stack is not None:
            yield packed(TaskContext.get().partitionId(), stack)

    def again(number: int, lines: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(lines["line"].to_numpy())
        return packed(number, factor(np.zeros((0, rows.shape[1])), rows))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [line for frame in frames for line in frame["line"]]
        if lines:
            values = np.linalg.svd(np.stack(lines), compute_uv=False)[:k]
            yield pd.DataFrame({"position": np.arange(1, len(values) + 1), "singular_value": values})

    schema = "part int, line array<double>"
    held = vectors.where(F.col("embedding").isNotNull()).select("embedding")
    factors = materialise(held.mapInPandas(first, schema), "factors")
    width, last = factors.agg(F.max(F.size("line")), F.max("part")).first()
    fan = max(2, stack_bytes // max(1, 8 * (width or 1) ** 2))
    while last:
        stacks = factors.groupBy(F.floor(F.col("part") / fan).cast("int").alias("next"))
        factors = materialise(stacks.applyInPandas(lambda key, lines: again(key[0], lines), schema), "factors")
        last //= fan
    return factors.coalesce(1).mapInPandas(solve, "position int, singular_value double")


def series_spectrum(series: DataFrame, key: str, time: str, value: str, longest: int = 1 << 20) -> DataFrame:
    """Mean, deviation, maximum and minimum of the FFT magnitudes of each key's series.

    The series has one point per time step between the first and the last of its
    key; steps without a point count as 0. Series of up to ``longest`` steps are
    transformed by one task each, longer ones in blocks by many, to the same figures.
    """

    def spectrum(points: pd.DataFrame) -> pd.DataFrame:
        at = points[time].to_numpy()
        full = np.zeros(int(at.max() - at.min()) + 1)
        full[at - at.min()] = points[value]
        size = np.abs(np.fft.fft(full))
        return pd.DataFrame(
            {
                key: [points[key].iloc[0]], "points": [len(full)], "mean": [size.mean()],
                "std": [size.std()], "max": [size.max()], "min": [size.min()],
            }
        )

    kind = series.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, points bigint, mean double, std double, max double, min double"
    steps = materialise(series.groupBy(key, time).agg(F.sum(value).alias(value)), "steps")
    spans = steps.groupBy(F.col(key).alias("_key")).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    wide = materialise(spans.where(F.col("_high") - F.col("_low") >= longest), "long-series")
    if wide.isEmpty():
        return steps.groupBy(key).applyInPandas(spectrum, schema)
    same = F.col(key).eqNullSafe(F.col("_key"))
    short = steps.join(wide, same, "left_anti").groupBy(key).applyInPandas(spectrum, schema)
    points = steps.join(wide, same).select(
        F.col("_key").alias("key"), (F.col("_high") - F.col("_low") + 1).cast("bigint").alias("points"),
        (F.col(time) - F.col("_low")).cast("bigint").alias("at"), F.col(value).cast("double").alias("re"),
    )
    sizes = _long_magnitudes(points).groupBy("key", "points").agg(
        F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"), F.max("size").alias("max"), F.min("size").alias("min")
    )
    return short.unionByName(sizes.withColumnRenamed("key", key))


def _shape(points: int) -> tuple[int, int]:
    """Rows and columns, powers of two, of the grid on which a series of so many points is transformed."""
    bits = max(2, int(2 * points - 1).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def _turn(part: np.ndarray, whole: int) -> np.ndarray:
    """exp(-2 pi i part / whole) for whole numbers, reduced before they lose digits."""
    return np.exp(-2j * np.pi * ((part % whole) / whole))


def _long_magnitudes(series: DataFrame) -> DataFrame:
    """``key, points, size``: FFT magnitudes of series (``key, points, at, re``) too long for one task.

    A transform of any length is a convolution with a chirp, whose transforms
    have a length that is a power of two. Such a transform is done on a grid: FFTs of
    the columns, a turn of each cell, FFTs of the rows. Each column and each row is a
    group of its own, of about the square root of the length. The chirp is not
    data: each column makes its own part of it.
    """
    kind = series.schema["key"].dataType.simpleString()
    grid = F.udf(lambda n: _shape(n)[1], "bigint")  # once per series
    cells = f"key {kind}, points bigint, row bigint, col bigint"
    width = series.select("key", "points").distinct().withColumn("width", grid("points"))
    width = materialise(width, "grids")
    same = F.col("key").eqNullSafe(F.col("_k"))
    shapes = width.select(F.col("key").alias("_k"), "width")
    placed = series.join(shapes, same).select(
        "key", "points", F.floor(F.col("at") / F.col("width")).alias("row"), (F.col("at") % F.col("width")).alias("col"), "re"
    )
    # Every column takes part, also one without points.
    empty = width.select(
        "key", "points", F.lit(-1).cast("bigint").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("col"),
        F.lit(0.0).alias("re"),
    )

    def frame(group: pd.DataFrame, **columns) -> pd.DataFrame:
        rows = len(next(iter(columns.values())))
        return pd.DataFrame({"key": [group["key"].iloc[0]] * rows, "points": [group["points"].iloc[0]] * rows} | columns)

    def both_columns(group: pd.DataFrame) -> pd.DataFrame:
        n, col = int(group["points"].iloc[0]), int(group["col"].iloc[0])
        rows, columns = _shape(n)
        held = group[group["row"] >= 0]
        at = held["row"].to_numpy() * columns + col
        data = np.zeros(rows, dtype=complex)
        data[held["row"]] = held["re"] * _turn(at * at, 2 * n)
        place = np.arange(rows) * columns + col
        back = rows * columns - place
        chirp = np.where(place < n, _turn(place * place, 2 * n), np.where(back < n, _turn(back * back, 2 * n), 0)).conj()
        turn = _turn(np.arange(rows) * col, rows * columns)
        a, b = np.fft.fft(data) * turn, np.fft.fft(chirp) * turn
        return frame(group, row=np.arange(rows), col=np.full(rows, col), ar=a.real, ai=a.imag, br=b.real, bi=b.imag)

    def both_rows(group: pd.DataFrame) -> pd.DataFrame:
        rows, columns = _shape(int(group["points"].iloc[0]))
        group = group.sort_values("col")
        a = np.fft.fft(group["ar"].to_numpy() + 1j * group["ai"].to_numpy())
        b = np.fft.fft(group["br"].to_numpy() + 1j * group["bi"].to_numpy())
        # The inverse transform is the transform of the conjugate.
        product = (a * b).conj()
        at = int(group["row"].iloc[0]) + rows * np.arange(columns)
        return frame(group, row=at // columns, col=at % columns, ar=product.real, ai=product.imag)

    def one_column(group: pd.DataFrame) -> pd.DataFrame:
        rows, columns = _shape(int(group["points"].iloc[0]))
        group = group.sort_values("row")
        col = int(group["col"].iloc[0])
        found = np.fft.fft(group["ar"].to_numpy() + 1j * group["ai"].to_numpy()) * _turn(np.arange(rows) * col, rows * columns)
        return frame(group, row=np.arange(rows), col=np.full(rows, col), ar=found.real, ai=found.imag)

    def one_row(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["points"].iloc[0])
        rows, columns = _shape(n)
        group = group.sort_values("col")
        found = np.fft.fft(group["ar"].to_numpy() + 1j * group["ai"].to_numpy()) / (rows * columns)
        at = int(group["row"].iloc[0]) + rows * np.arange(columns)
        return frame(group, size=np.abs(found[at < n]))

    two, one = f"{cells}, ar double, ai double, br double, bi double", f"{cells}, ar double, ai double"
    first = placed.unionByName(empty).groupBy("key", "points", "col").applyInPandas(both_columns, two)
    second = first.groupBy("key", "points", "row").applyInPandas(both_rows, one)
    third = second.groupBy("key", "points", "col").applyInPandas(one_column, one)
    return third.groupBy("key", "points", "row").applyInPandas(one_row, f"key {kind}, points bigint, size double")
