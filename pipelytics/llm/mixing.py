"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates
between 0 and ``cap`` that bring every source to its target of words, those
nearest to one copy each in relative entropy are exponential tilts:
``rate = cap * q e^t / (1 - q + q e^t)`` with ``q = 1 / cap`` and ``t`` the
source's multiplier times the document's size. The multipliers solve a convex
dual problem, one equation per source, by Newton steps on sums that Spark
gathers. Rates become whole copies in bounded groups that carry their rounding
error on, so that a group misses its target by a small document at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialise
from .common import WORD

_SUM = "decimal(38,12)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, group: str, size: str, weights: Sequence[float], total: float, cap: float
) -> DataFrame:
    """One row per source: its size and its target of words.

    Sources are ordered by code point, null last, and weighted in turn. They
    share ``total`` times all words by weight; a target stops at ``cap`` times
    its source's size and the excess is shared anew by weight, which ends at the
    level ``target = min(cap * size, level * weight)``. The level follows from
    running sums over the sources, sorted by the level at which each is full.
    """
    per = sizes.groupBy(F.col(group)).agg(
        F.sum(F.col(size)).alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    place = F.row_number().over(Window.orderBy(F.col(group).isNull(), F.col(group))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighted = per.withColumn("_w", weight).withColumn("_full", cap * F.col("source_size") / F.col("_w"))
    by_level = Window.orderBy("_full", F.col(group).isNull(), F.col(group))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    staged = weighted.select(
        "*",
        F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0.0)).alias("_filled"),
        F.coalesce(F.sum("_w").over(upto), F.lit(0.0)).alias("_w_before"),
        F.row_number().over(by_level).alias("_at"),
        F.sum("_w").over(everything).alias("_w_all"),
        (total * F.sum("source_size").over(everything)).alias("_total"),
    )
    level_here = (F.col("_total") - F.col("_filled")) / (F.col("_w_all") - F.col("_w_before"))
    # The level is that of the first source which it does not fill; without one, all are full.
    first = F.struct("_at", level_here.alias("level"))
    level = F.min(F.when(level_here <= F.col("_full"), first)).over(everything)["level"]
    target = F.least(
        cap * F.col("source_size"), F.coalesce(level * F.col("_w"), cap * F.col("source_size"))
    )
    return staged.select(group, "source_size", "source_rows", target.cast("double").alias("target"))


def multipliers(
    sizes: DataFrame, wanted: DataFrame, group: str, size: str, cap: float, tolerance: float = 1e-9, most_rounds: int = 60
) -> DataFrame:
    """``wanted`` with ``scale`` (mean size) and ``multiplier`` of each source, by distributed Newton steps.

    Works on the histogram of sizes per source, so a source with most of the
    documents costs no more than its distinct sizes. A step that leaves the
    bracket known to hold the solution is replaced by its middle. Sums are
    decimal, so reruns agree bit by bit. A source that is to be taken ``cap``
    times over, or not at all, has no finite multiplier and gets a null one.
    """
    histogram = materialise(
        sizes.where(F.col(size) > 0).groupBy(F.col(group).alias("_g"), F.col(size).alias("_x")).agg(
            F.count(F.lit(1)).alias("_n")
        ),
        "size-histogram",
    )
    full = cap * F.col("source_size")
    solvable = (F.col("target") > full * 1e-9) & (F.col("target") < full * (1 - 1e-9))
    state = materialise(
        wanted.select(
            "*",
            (F.col("source_size") / F.col("source_rows")).alias("scale"),
            F.when(solvable, F.lit(0.0)).alias("multiplier"),
            F.lit(-1e4).alias("_low"),
            F.lit(1e4).alias("_high"),
            F.lit(None).cast("double").alias("_miss"),
        ),
        "multipliers",
    )
    for _ in range(most_rounds):
        x = F.col("_x") / F.col("scale")
        rate = rates(F.col("_x"), F.col("scale"), F.col("multiplier"), cap)
        sums = (
            histogram.join(state.where("multiplier is not null"), F.col("_g").eqNullSafe(F.col(group)))
            .groupBy("_g")
            .agg(
                F.sum((F.col("_n") * x * rate).cast(_SUM)).cast("double").alias("_value"),
                F.sum((F.col("_n") * x * x * rate * (1 - rate / cap)).cast(_SUM)).cast("double").alias("_slope"),
            )
        )
        miss = F.col("_value") - F.col("target") / F.col("scale")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("_low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("_high"))
        step = F.col("multiplier") - miss / F.col("_slope")
        inside = (F.col("_slope") > 0) & (step > low) & (step < high)
        moved = F.round(F.when(inside, step).otherwise((low + high) / 2), 12)
        off = F.abs(miss) / (F.col("target") / F.col("scale"))
        settled = off <= tolerance
        state = materialise(
            state.join(sums, F.col("_g").eqNullSafe(F.col(group)), "left").select(
                *[c for c in state.columns if c not in ("multiplier", "_low", "_high", "_miss")],
                F.when(F.col("multiplier").isNotNull(), F.when(settled, F.col("multiplier")).otherwise(moved)).alias("multiplier"),
                F.coalesce(low, F.col("_low")).alias("_low"),
                F.coalesce(high, F.col("_high")).alias("_high"),
                off.alias("_miss"),
            ),
            "multipliers",
        )
        worst = state.agg(F.max("_miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.drop("_low", "_high", "_miss")


def rates(size: Column, scale: Column, multiplier: Column, cap: float) -> Column:
    """Tilted expected copies of a document of ``size`` words."""
    tilt = F.least(F.greatest(multiplier * size / scale, F.lit(-700.0)), F.lit(700.0))
    return cap / (1 + (cap - 1) * F.exp(-tilt))


def round_group(sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whole copies near the rates, largest documents first, each making up for the error so far."""
    copies = np.zeros(len(sizes), dtype=np.int64)
    error = 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), wanted.tolist(), strict=True)):
        low, high = math.floor(rate), math.ceil(rate)
        if size:
            best = math.floor((rate * size + error) / size + 0.5)
            copies[i] = min(max(best, low), high)
            error += (rate - copies[i]) * size
        else:
            copies[i] = low
    return copies


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    size: str = "size",
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    cap: int = 2,
    bucket_rows: int = 4096,
) -> DataFrame:
    """One row per document: ``key``, ``group``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``.

    Sources are cut into buckets of about ``bucket_rows`` documents by a hash of
    the row, and each bucket is rounded on its own. Null sources form one
    source, ordered last. Documents without words get one copy unless their
    source is taken 0 times; they weigh nothing. Repeated rows are rows like any
    others; which of several equal rows gets a copy more is immaterial.
    """
    base = docs.select(F.col(key), F.col(group), F.col(size).cast("bigint").alias(size))
    wanted = targets(base, group, size, weights, total, float(cap))
    solved = multipliers(base, wanted, group, size, float(cap))
    solved = solved.withColumnRenamed(group, "_g")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    rate = (
        F.when(F.col("multiplier").isNotNull(), rates(F.col(size), F.col("scale"), F.col("multiplier"), float(cap)))
        .when(full, F.lit(float(cap)))
        .otherwise(F.lit(0.0))
    )
    rate = F.when(F.col(size) == 0, F.lit(1.0)).otherwise(rate)
    buckets = F.ceil(F.col("source_rows") / bucket_rows)
    rated = base.join(solved, F.col(group).eqNullSafe(F.col("_g"))).select(
        key,
        group,
        size,
        "source_size",
        "target",
        F.round(rate, 9).alias("rate"),
        F.pmod(F.xxhash64(key, size, F.lit(7)), buckets).alias("_bucket"),
        F.xxhash64(F.lit(11), key).alias("_tie"),
    )
    schema = rated.drop("_bucket", "_tie").schema.add("copies", LongType())

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([size, "_tie"], ascending=[False, True], kind="stable", ignore_index=True)
        frame["copies"] = round_group(frame[size].to_numpy(), frame["rate"].to_numpy())
        return frame.drop(columns=["_bucket", "_tie"])

    return rated.groupBy(group, "_bucket").applyInPandas(settle, schema)
