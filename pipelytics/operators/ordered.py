"""Ordered computations that stay parallel when one key holds most rows.

A plain window puts all rows of a key into one task. The helpers here cut each
key's ordered rows into contiguous segments first, so no task ever sees more
than one segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

_SEG = "_seg"


def range_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None
) -> DataFrame:
    """Range-partition by keys and order, and tag rows with their partition.

    ``order`` must be unique within a key, else ties could straddle segments in
    an undefined way. The tagged rows are written once, so that every later
    branch agrees on the cut points even if a task is re-run.
    """
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *keys, *order).withColumn(_SEG, F.spark_partition_id())
    return materialise(tagged, "segments")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    segments: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key, and with ``totals`` a key's sum as ``<name>_total``.

    Sum per segment, run over the few segment totals of a key, then add each
    segment's starting point to a window that is local to the segment.
    """
    for name, expr in sums.items():
        df = df.withColumn(f"_in_{name}", expr)
    staged = range_segments(df, keys, order, segments)
    per_segment = staged.groupBy(*keys, _SEG).agg(
        *[F.sum(f"_in_{name}").alias(f"_tot_{name}") for name in sums]
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_segment.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        F.col(_SEG).alias("_s_seg"),
        *[F.sum(f"_tot_{name}").over(earlier).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_tot_{name}").over(whole).alias(f"{name}_total") for name in sums if totals],
    )
    within = (
        Window.partitionBy(*keys, _SEG)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = staged.select(
        "*", *[F.sum(f"_in_{name}").over(within).alias(f"_local_{name}") for name in sums]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    joined = local.join(starts, reduce(lambda a, b: a & b, same, F.col(_SEG) == F.col("_s_seg")))
    kept = [c for c in df.columns if not c.startswith("_in_")]
    return joined.select(
        *kept,
        *[
            (F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.col(f"_local_{name}")).alias(name)
            for name in sums
        ],
        *[f"{name}_total" for name in sums if totals],
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    segments: int | None = None,
) -> DataFrame:
    """``row_number()`` per key without gathering a key in one task."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, segments)


def with_preceding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    columns,
    block: int = 100_000,
    segments: int | None = None,
) -> DataFrame:
    """Window columns that look back at most ``before`` rows within a key.

    Rows are numbered, cut into blocks of ``block`` rows, and the last
    ``before`` rows of a block are copied into the next one, which makes every
    look-back local to a block. ``columns(window)`` receives a partitioned and
    ordered window spec and returns the columns to add, by name. The row number
    is kept as ``rn``.
    """
    block = max(block, before)
    numbered = row_numbers(df, keys, order, "rn", segments)
    pos = F.col("rn") - 1
    own = F.floor(pos / block).cast("bigint")
    shared = pos % block >= block - before
    spread = numbered.withColumn("_own", own).withColumn(
        "_block",
        F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    spec = Window.partitionBy(*keys, "_block").orderBy("rn")
    added = columns(spec)
    return (
        spread.select("*", *[c.alias(name) for name, c in added.items()])
        .where("_own = _block")
        .drop("_own", "_block")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    segments: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    Works on counts per distinct value, so duplicates cost nothing and no
    aggregation buffer grows with a group.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_sums(counts, keys, ["_v"], {"_upto": F.col("_n")}, segments, totals=True)
    aggs = []
    for name, p in probs.items():
        rank = (F.col("_upto_total") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
        aggs.append(
            F.struct(at(low).alias("lo"), at(high).alias("hi"), F.max(rank - low).alias("f")).alias(name)
        )
    picked = ranked.groupBy(*keys).agg(*aggs)
    blend = lambda c: F.col(f"{c}.lo") + (F.col(f"{c}.hi") - F.col(f"{c}.lo")) * F.col(f"{c}.f")
    return picked.select(*keys, *[blend(name).alias(name) for name in probs])
