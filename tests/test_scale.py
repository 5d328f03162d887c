"""Values, keys and batches of kinds that the small tables do not hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pipelytics.functions.exact import fine_mean, fine_sum
from pipelytics.operators import features, monitor, quality
from pipelytics.session import scratch_path
from pipelytics.sources import writers
from pipelytics.streaming import jobs
from pipelytics.streaming.runner import open_stream


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sums_of_any_size(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        def total(*values):
            df = spark.createDataFrame([(v,) for v in values], "v double")
            return df.agg(fine_sum("v").alias("s"), fine_mean("v").alias("m")).first()["s"]

        assert total(2e9, 1.0) == 2e9 + 1
        assert total(5e12, 1e-7) == 5e12 + 1e-7
        assert total(1e-7, 2e-7) == pytest.approx(3e-7)
        assert total(1e30, 1.0) == 1e30
        assert total(None, 1.5) == 1.5
        assert total() is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_sums_at_the_edges_of_bands(spark):
    def total(values, parts=1):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(parts)
        return df.agg(fine_sum("v")).first()[0]

    assert total([9e28] * 20) == pytest.approx(1.8e30, rel=1e-15)
    assert total([4e-10] * 10) == pytest.approx(4e-9, rel=1e-12)
    assert total([1e-25, 2e-25]) == pytest.approx(3e-25, rel=1e-9)
    assert total([0.0, -0.0]) == 0.0
    assert total([1e25, 1.0, -1e25]) == 1.0  # doubles added in this order give 0
    assert total([1e70, 1.0]) == 1e70 and total([float("inf"), 1.0]) == float("inf")
    assert math.isnan(total([float("nan"), 1.0]))
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-26, 39) for _ in range(3000)]
    sums = set()
    for parts in (1, 3, 7):
        rng.shuffle(values)
        sums.add(total(values, parts))
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), rel=1e-14)


def test_summary_of_small_and_large(spark):
    df = spark.createDataFrame([(1e-5, 5e12), (2e-5, 5e12), (4e-5, 5e12)], "a double, b double")
    found = {r["column_name"]: r for r in quality.summary_stats(df, ["a", "b"]).collect()}
    assert found["a"]["mean"] == pytest.approx(7e-5 / 3)
    assert found["a"]["std"] == pytest.approx(1.2472e-5, rel=1e-4)
    assert found["b"]["mean"] == 5e12 and found["b"]["std"] == 0


def test_small_outlier_is_found(spark):
    rows = [(1, i, 1e-6 * (1 + i % 3)) for i in range(30)] + [(1, 30, 5e-3)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    assert [r["t"] for r in monitor.rolling_anomalies(df, "k", ["t"], "v", 20, 3.0).collect()] == [30]


def test_drift_from_a_constant(spark):
    old, new = spark.range(50).select(F.lit(7.0).alias("v")), spark.range(50).select(F.lit(900.0).alias("v"))
    assert features.feature_drift(old, new, ["v"]).first()["psi"] > 10
    assert features.feature_drift(old, old, ["v"]).first()["psi"] == 0
    none = spark.range(50).select(F.lit(None).cast("double").alias("v"))
    assert features.feature_drift(old, none, ["v"]).first()["psi"] > 10


def test_repeated_customers_and_null_customer(spark):
    orders = spark.createDataFrame([(1, 1, 5.0), (2, None, 5.0)], "order_id int, customer_id int, total_amount double")
    customers = spark.createDataFrame([(1,), (1,)], "customer_id int")
    row = quality.validation_report(orders, customers).first()
    assert (row["total_rows"], row["duplicates"], row["invalid_customers"]) == (2, 0, 1)


def test_upsert_without_success_marker(spark):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        path = scratch_path(spark, "versions")
        for k in (1, 2):
            out = writers.upsert_customer_metrics(path, spark.createDataFrame([(k, 1.0)], "k int, v double"), ["k"])
        assert sorted(r["k"] for r in out.collect()) == [1, 2]
        assert writers.drop_versions(spark, path, keep=1) == [0]
        assert writers.read_latest(spark, path).count() == 2
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_versions_without_commit_are_no_empty_table(spark):
    path = scratch_path(spark, "versions")
    spark.range(3).write.parquet(f"{path}/version=0")
    with pytest.raises(ValueError, match="complete"):
        writers.upsert_customer_metrics(path, spark.createDataFrame([(1, 1.0)], "k int, v double"), ["k"], version=1)


@pytest.mark.parametrize("files", [1, 3, 5])
def test_stream_upsert_adds_batches_up(spark, files):
    inbox, state, out = (scratch_path(spark, x) for x in ("in", "state", "out"))
    orders = spark.createDataFrame([(i % 2, 10.0, i) for i in range(10)], "customer_id int, amount double, day int")
    for n in range(files):
        orders.where(F.col("day") % files == n).coalesce(1).write.parquet(f"{inbox}/chunk={n}")

    def metrics(batch):
        return batch.groupBy("customer_id").agg(
            F.sum("amount").alias("lifetime_value"), F.count("*").alias("order_count"), F.max("day").alias("last_order")
        )

    found = None
    for _ in range(1):
        stream = open_stream(spark, f"{inbox}/chunk=*", orders.schema)
        found = jobs.stream_upsert_metrics(stream, out, metrics, ["customer_id"], state)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 50.0, 5, 8), (1, 50.0, 5, 9)]
