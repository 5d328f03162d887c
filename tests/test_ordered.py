"""Segmented order operators against plain windows, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipelytics.operators.ordered import exact_quantiles, row_numbers, running_sums, with_preceding


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; key 0 holds two thirds, and half of its rows share one order value."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11).alias("o"),
        "id",
        ((F.col("id") * 37) % 101).alias("v"),
    ).persist()


@pytest.mark.parametrize("segments", [1, 3, 16])
def test_running_sums(skewed, rows, segments):
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("v").over(w)).withColumn("rn", F.count("v").over(w))
    got = running_sums(
        skewed, ["k"], ["o", "id"], {"s": F.col("v"), "rn": F.lit(1).cast("bigint")}, segments
    )
    assert rows(got) == rows(want)


def test_segments_are_bounded(skewed):
    from pipelytics.operators.ordered import range_segments

    sizes = range_segments(skewed, ["k"], ["o", "id"], 16).groupBy("_seg").count()
    assert sizes.agg(F.max("count")).first()[0] < 3000 / 4


def test_null_keys_are_kept(spark, rows):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "k string, o int, v int")
    got = running_sums(df, ["k"], ["o"], {"s": F.col("v")}, 2)
    assert rows(got.select("k", "o", "s")) == sorted([(None, 1, 2), (None, 2, 5), ("a", 1, 4)], key=repr)


def test_no_keys(skewed):
    got = row_numbers(skewed, [], ["id"], "rn", 5).where("rn != id + 1")
    assert got.count() == 0


@pytest.mark.parametrize("before,block", [(1, 1), (4, 4), (4, 10), (7, 100)])
def test_look_back_across_blocks(skewed, rows, before, block):
    plain = Window.partitionBy("k").orderBy("o", "id")

    def columns(spec):
        return {"s": F.sum("v").over(spec.rowsBetween(-before, 0)), "p": F.lag("v").over(spec)}

    want = skewed.select("*", *[c.alias(n) for n, c in columns(plain).items()])
    got = with_preceding(skewed, ["k"], ["o", "id"], before, columns, block, segments=5).drop("rn")
    assert rows(got) == rows(want)


def test_exact_quantiles(skewed):
    probs = {"a": 0.0, "b": 0.25, "c": 0.8, "d": 0.95, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", probs, 4).collect()}
    data = skewed.toPandas().groupby("k")["v"]
    assert len(got) == data.ngroups
    for k, values in data:
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, [], "v", {"q": 0.5}).first()["q"] is None
